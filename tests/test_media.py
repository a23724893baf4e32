"""Media paths with stand-ins for the optional decoders."""

import os
import sys
import types

import numpy as np
import pytest

from chronoframe.functions import image
from chronoframe.sources import media

CLIPS = {"a.mp4": 3, "empty.mp4": 0}


class Capture:
    def __init__(self, path):
        self.n, self.at = CLIPS.get(os.path.basename(path)), 0

    def isOpened(self):
        return self.n is not None

    def read(self):
        if self.at >= self.n:
            return False, None
        self.at += 1
        return True, np.full((48, 64, 3), 40 * self.at, np.uint8)

    def get(self, what):
        return {"msec": 500.0 * (self.at - 1), "fps": 2.0, "count": self.n}[what]

    def release(self):
        self.n = 0


@pytest.fixture
def decoder(monkeypatch):
    monkeypatch.setitem(sys.modules, "cv2", types.SimpleNamespace(VideoCapture=Capture, CAP_PROP_POS_MSEC="msec", CAP_PROP_FPS="fps", CAP_PROP_FRAME_COUNT="count"))


def test_video_frames(decoder):
    reader = media.VideoFrames({"paths": "/x/a.mp4,/x/empty.mp4,/x/none.mp4"}).reader(None)
    a, empty, none = reader.partitions()
    rows = list(reader.read(a))
    assert [r[1:5] for r in rows] == [(0, 0.0, 64, 48), (1, 0.5, 64, 48), (2, 1.0, 64, 48)]
    assert len({r[0] for r in rows}) == 1 and all(len(r[5]) == 320 * 240 for r in rows) and rows[0][5] != rows[1][5]
    for broken in (empty, none):
        with pytest.raises(OSError, match="can't open|no first frame"):
            list(reader.read(broken))


def test_probe(decoder):
    assert media.probe("/x/a.mp4") == {"path": "/x/a.mp4", "video_name": "a.mp4", "fps": 2.0, "total_frames": 3, "duration": 1.5}
    with pytest.raises(OSError, match="can't open"):
        media.probe("/x/none.mp4")


def test_sound_and_clips(tmp_path, monkeypatch):
    monkeypatch.setenv("PATH", str(tmp_path))
    wav, clip = str(tmp_path / "a.wav"), str(tmp_path / "clip.mp4")
    assert not media.extract_audio("a.mp4", wav) and media.cut_chunk("a.mp4", 1.0, 3.5, clip) is None
    tool = tmp_path / "ffmpeg"
    tool.write_text('#!/bin/sh\nfor x; do last=$x; done\ncase "$*" in *broken*) exit 1;; esac\necho "$*" > "$last"\n')
    tool.chmod(0o755)
    assert media.extract_audio("a.mp4", wav) and "-ar 16000" in open(wav).read()
    assert not media.extract_audio("broken.mp4", str(tmp_path / "b.wav"))
    assert media.cut_chunk("a.mp4", 1.0, 3.5, clip) == clip and "-ss 1.0 -i a.mp4 -t 2.5" in open(clip).read()
    assert media.cut_chunk("broken.mp4", 1.0, 3.5, clip) == clip  # it's there already
    assert media.cut_chunk("broken.mp4", 1.0, 3.5, str(tmp_path / "c.mp4")) is None


def test_data_uri(monkeypatch):
    class Image:
        LANCZOS = 1

        def __init__(self, width, height):
            self.size, self.width, self.height = (width, height), width, height

        @staticmethod
        def fromarray(rgb):
            return Image(rgb.shape[1], rgb.shape[0])

        def resize(self, size, _):
            return Image(*size)

        def save(self, out, kind, quality):
            out.write(f"{kind} {self.width} {self.height} {quality}".encode())

    monkeypatch.setitem(sys.modules, "PIL", types.SimpleNamespace(Image=Image))
    import base64

    read = lambda uri: base64.b64decode(uri.removeprefix("data:image/jpeg;base64,")).decode()
    pixels = np.zeros((100, 200, 3), np.uint8)
    assert read(image.data_uri(pixels)) == "JPEG 200 100 85" and read(image.data_uri(pixels, longest=50, quality=70)) == "JPEG 50 25 70"
