"""Queries and their SQL, collected by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import ratio

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Named SQL subqueries; a query's SQL gets those that it needs in front.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "frames": ((), """SELECT user_id AS video_id, event_id AS frame_number,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS timestamp,
        CASE WHEN event_type IN ('view', 'click') THEN '' ELSE event_type END AS extracted_text,
        least(value / 100, 1.0) AS pixel_pct, event_type, value, props FROM events"""),
    "durations": (("frames",), "SELECT video_id, max(timestamp) AS duration FROM frames GROUP BY video_id"),
    "segments": ((), r"""SELECT conv_id AS video_id, turn, turn * 5.0::DOUBLE AS "start",
        turn * 5.0::DOUBLE + len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) * 0.4::DOUBLE AS "end", text FROM conversations"""),
    "spoken": ((), "SELECT DISTINCT conv_id AS video_id, turn AS frame_number, turn * 5.0::DOUBLE + 2.0 AS timestamp FROM conversations"),
    "nodes": ((), """SELECT printf('%d_%06d', label, vec_id) AS id, label::BIGINT AS video_id, vec_id AS frame_number,
        vec_id * 1.0::DOUBLE AS timestamp FROM embeddings"""),
    "vectors": ((), """SELECT printf('%d_%06d', e.label, e.vec_id) AS id, e.label::BIGINT AS video_id, e.vec_id AS frame_number,
        e.vec_id * 1.0::DOUBLE AS timestamp, coalesce(d.text, '') AS document, d.source, d.lang, e.embedding::DOUBLE[] AS embedding,
        e.label::BIGINT * 1000000000 + e.vec_id AS ord FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id"""),
    "changes": (("frames",), r"""SELECT *, CASE WHEN prior IS NULL THEN 'initial' WHEN prior = '' AND extracted_text <> '' THEN 'text_appeared'
        WHEN prior <> '' AND extracted_text = '' THEN 'text_disappeared' WHEN prior <> '' AND lower(extracted_text) <> lower(prior) THEN 'text_changed'
        WHEN prior = '' AND extracted_text = '' AND pixel_pct >= 0.8 THEN 'visual_change' END AS change_type
        FROM (SELECT *, lag(extracted_text) OVER (PARTITION BY video_id ORDER BY timestamp, frame_number) AS prior FROM frames)"""),
    "keyframes": (("changes",), "SELECT * FROM changes WHERE change_type IS NOT NULL"),
    "responses": (("frames",), """SELECT *, CASE event_type WHEN 'error' THEN 'refused' WHEN 'purchase' THEN CASE WHEN frame_number % 5 = 0 THEN 'garbage' ELSE 'json' END ELSE 'json' END AS outcome,
        value >= 50 AS one_person, value >= 80 AS two_actions FROM frames"""),
    "semantic": (("responses",), """SELECT *, outcome <> 'json' AS is_fallback,
        CASE WHEN outcome = 'json' THEN event_type ELSE 'Video content showing visual scene' END AS main_subject,
        CASE WHEN outcome = 'json' THEN 'other' ELSE 'video' END AS scene_type,
        CASE WHEN outcome = 'json' THEN extracted_text ELSE '' END AS said_text,
        CASE WHEN outcome = 'json' THEN one_person::INT ELSE 1 END AS people_count,
        CASE WHEN outcome = 'json' THEN two_actions ELSE true END AS has_actions FROM responses"""),
    "pairs": (("vectors",), """SELECT a.id AS source, b.id AS target, a.video_id = b.video_id AS same_video,
        CASE WHEN a.video_id = b.video_id THEN abs(a.frame_number - b.frame_number) END AS temporal_distance,
        list_cosine_similarity(a.embedding, b.embedding) AS similarity FROM vectors a JOIN vectors b ON a.ord < b.ord
        WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.3"""),
    "sem": (("pairs",), """SELECT source, target, CASE WHEN same_video AND temporal_distance <= 10 THEN similarity * pow(0.9, temporal_distance / 10.0) ELSE similarity END AS weight,
        'semantic' AS edge_type, same_video, similarity, temporal_distance FROM pairs"""),
    "tem": (("nodes",), """SELECT * FROM (SELECT id AS source, lead(id) OVER w AS target, 1.0::DOUBLE AS weight, 'temporal' AS edge_type, true AS same_video,
        lead(timestamp) OVER w - timestamp AS time_gap FROM nodes WINDOW w AS (PARTITION BY video_id ORDER BY frame_number)) WHERE target IS NOT NULL"""),
    "edges": (("sem", "tem"), """SELECT source, target, coalesce(t.weight, s.weight) AS weight, coalesce(t.edge_type, s.edge_type) AS edge_type,
        coalesce(t.same_video, s.same_video) AS same_video, s.similarity, s.temporal_distance, t.time_gap FROM sem s FULL JOIN tem t USING (source, target)"""),
    # the gate's state machine over sampled frames; texts here are alike enough only if they are equal, whatever the case
    "numbered": (("frames",), "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, frame_number) AS rn FROM frames"),
    "checks": (("numbered",), """SELECT video_id, rn, 43200.0::DOUBLE AS due FROM numbered WHERE rn = 1 UNION ALL SELECT c.video_id, min(f.rn), min(f.timestamp) + 43200.0
        FROM checks c JOIN numbered f ON f.video_id = c.video_id AND f.rn > c.rn AND f.timestamp >= c.due GROUP BY c.video_id"""),
    "due": (("checks",), "SELECT f.*, row_number() OVER (PARTITION BY f.video_id ORDER BY f.rn) AS k, lower(extracted_text) AS t FROM numbered f JOIN checks c ON c.video_id = f.video_id AND c.rn = f.rn"),
    "seen": (("due",), """SELECT *, t <> '' AND (coalesce(t = lag(t, 1) OVER w, false) OR coalesce(t = lag(t, 2) OVER w, false) OR coalesce(t = lag(t, 3) OVER w, false)) AS flicker
        FROM due WINDOW w AS (PARTITION BY video_id ORDER BY k)"""),
    "said": (("seen",), """SELECT video_id, k, frame_number, timestamp, 'initial' AS decision, 'initial' AS change_type, 1.0::DOUBLE AS score, 'Initial frame' AS reason, true AS accepted,
            extracted_text AS held, 0.0::DOUBLE AS since FROM seen WHERE k = 1
        UNION ALL SELECT video_id, k, frame_number, timestamp, decision, CASE WHEN decision IN ('flicker', 'same_text', 'low_pixel') THEN NULL ELSE kind END, score,
            CASE WHEN decision IN ('flicker', 'same_text', 'low_pixel') THEN NULL WHEN kind = 'text_appeared' THEN 'Text appeared' WHEN kind = 'text_disappeared' THEN 'Text disappeared'
                WHEN kind = 'text_changed' THEN printf('Text changed (sim: %.2f)', 1 - score) ELSE printf('%.1f%% pixels changed', score * 100) END,
            coalesce(decision = kind, false), CASE WHEN decision = kind THEN extracted_text ELSE held END, CASE WHEN decision = kind THEN timestamp ELSE since END
        FROM (SELECT *, CASE WHEN flicker THEN 'flicker' WHEN kind IS NULL THEN CASE WHEN extracted_text <> '' OR held <> '' THEN 'same_text' ELSE 'low_pixel' END
                WHEN timestamp - since < 64800 THEN 'too_close' ELSE kind END AS decision,
                CASE WHEN flicker THEN NULL WHEN kind LIKE 'text_%' THEN 1.0 - same WHEN extracted_text = '' AND held = '' THEN pixel_pct END AS score
            FROM (SELECT s.*, g.held, g.since, <ratios> AS same, CASE WHEN s.t = lower(g.held) THEN CASE WHEN s.t = '' AND s.pixel_pct >= 0.8 THEN 'visual_change' END
                    WHEN g.held = '' THEN 'text_appeared' WHEN s.t = '' THEN 'text_disappeared' ELSE 'text_changed' END AS kind
                FROM said g JOIN seen s ON s.video_id = g.video_id AND s.k = g.k + 1))"""),
}
#: Rounds of the fixed-count PageRank.
ROUNDS = 20


#: The texts that frames of the test tables hold.
TEXTS = ("error", "purchase", "signup")


def _gate_parts() -> None:
    """SQL has no difflib; the ratios of the few texts that there are stand in the SQL as numbers."""
    cases = " ".join(f"WHEN s.t = '{a}' AND lower(g.held) = '{b}' THEN {ratio(a, b)!r}" for a in TEXTS for b in TEXTS if a != b)
    needs, sql = PARTS["said"]
    PARTS["said"] = (needs, sql.replace("<ratios>", f"(CASE {cases} ELSE 0.0 END)::DOUBLE"))


def _rank_parts() -> None:
    PARTS["outs"] = (("edges",), "SELECT source, sum(weight) AS total FROM edges GROUP BY source")
    PARTS["n"] = (("nodes",), "SELECT count(*)::DOUBLE AS n FROM nodes")
    PARTS["r0"] = (("nodes", "n"), "SELECT id, 1 / (SELECT n FROM n) AS r FROM nodes")
    for k in range(ROUNDS):
        PARTS[f"r{k + 1}"] = ((f"r{k}", "edges", "outs", "n"), f"""SELECT p.id, 0.85 * (coalesce(c.got, 0) + (SELECT coalesce(sum(r), 0) FROM r{k} WHERE id NOT IN (SELECT source FROM outs)) / (SELECT n FROM n))
            + 0.15 / (SELECT n FROM n) AS r FROM r{k} p LEFT JOIN (SELECT e.target, sum(q.r * e.weight / o.total) AS got FROM edges e JOIN outs o ON o.source = e.source JOIN r{k} q ON q.id = e.source GROUP BY e.target) c ON c.target = p.id""")  # fmt: skip
    PARTS["ranked"] = ((f"r{ROUNDS}", "nodes"), f"SELECT nodes.*, r AS importance FROM nodes JOIN r{ROUNDS} USING (id)")


_rank_parts()
_gate_parts()


def with_parts(sql: str, *needs: str) -> str:
    """`sql` with its named subqueries, and theirs, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in PARTS[name][0]:
                add(x)
            order.append(name)

    for name in needs:
        add(name)
    heads = [f"{x} AS MATERIALIZED ({PARTS[x][1]})" for x in order]
    if "checks" in order:  # these parts name themselves
        heads = [h.replace(" AS MATERIALIZED (", " AS (", 1) if h.split(" ", 1)[0] in ("checks", "said") else h for h in heads]
        return "WITH RECURSIVE " + ", ".join(heads) + " " + sql
    if sql.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*heads, sql.removeprefix("WITH RECURSIVE ")])
    return ("WITH " + ", ".join(heads) + " " if heads else "") + sql


def _plain_counts(sql: str) -> str:
    """count_if(x) as a filtered count, whose type is BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def query(sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _plain_counts(with_parts(sql, *needs))
        return f

    return register
