"""The same queries in SQL, written apart from the DataFrame code: windows where that folds, joins where that nests."""

from __future__ import annotations

from ..functions import lexicon as L
from .queries import PASSAGES, PROTOTYPES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cue(col: str, phrases: list[str]) -> str:
    return f"regexp_matches({col}, {q(L.any_of(phrases))})"


def _flat(s: str) -> str:
    return "||chr(10)||".join(map(q, s.split("\n")))


STRIP = r"regexp_replace({0}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
strip = STRIP.format
SEEDED = "seeded AS (SELECT doc_id, lang, source, coalesce(text, '') || '.' || chr(10) || CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN {_flat(p)}" for i, p in enumerate(PASSAGES)) + " END AS text FROM documents)"


def sents(name: str, src: str, text: str) -> str:
    """(doc_id, sent_index, sent)"""
    parts = f"list_filter(list_transform(regexp_extract_all({text}, '[^.!?]*[.!?]|[^.!?]+'), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"{name} AS (SELECT doc_id, unnest(range(len(l))) AS sent_index, unnest(l) AS sent FROM (SELECT doc_id, {parts} AS l FROM {src}))"


def _label(low: str) -> str:
    return "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches({low}, {q(n)})" for n in needs) + f" THEN {q(name)}" for name, needs in L.SECTIONS) + " END"


SECTIONS = rf"""
lns AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS ln FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\v\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {strip("x")}), lambda x: x <> '') AS l FROM seeded)),
lab AS (SELECT doc_id, n, ln, {_label("lower(ln)")} AS s FROM lns),
fil AS (SELECT doc_id, n, ln, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), 'introduction') AS section FROM lab),
sec AS (SELECT doc_id, section, string_agg(ln || chr(10), '' ORDER BY n) AS body FROM fil GROUP BY doc_id, section)"""
_ONE = lambda s: f"coalesce(max(body) FILTER (section = '{s}'), '')"
BUCKETS = f"""wide AS (SELECT d.doc_id, {", ".join(f"{_ONE(s)} AS {s}" for s in ("introduction", "related", "discussion", "conclusion", "limitations"))} FROM seeded d LEFT JOIN sec USING (doc_id) GROUP BY d.doc_id),
bucket AS (SELECT doc_id, introduction || chr(10) || related || chr(10) || discussion || chr(10) || conclusion AS q, CASE WHEN limitations <> '' THEN limitations ELSE discussion END AS l FROM wide)"""


def key(s: str) -> str:
    bare = rf"regexp_replace(lower({s}), '\([ \t\n\r\f\v]*[0-9]{{1,4}}[ \t\n\r\f\v]*\)|\[[ \t\n\r\f\v]*[0-9]{{1,4}}[ \t\n\r\f\v]*\]', ' ', 'g')"
    return strip(rf"regexp_replace({bare}, '[ \t\n\r\f\v]+', ' ', 'g')")


RQ = f"""{sents("qs", "bucket", "q")},
rq0 AS (SELECT *, {key("sent")} AS key FROM qs WHERE length(sent) BETWEEN 30 AND 280),
rq1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY sent_index) AS nth FROM rq0 WHERE {cue("key", L.QUESTION)} AND (ends_with(sent, '?') OR regexp_matches(key, 'we |aim|hypothesi'))),
rq AS (SELECT doc_id, sent_index, sent, CASE WHEN ends_with(regexp_replace(sent, '\\.$', ''), '?') THEN regexp_replace(sent, '\\.$', '') ELSE regexp_replace(sent, '\\.$', '') || '?' END AS question FROM rq1 WHERE nth = 1)"""
LIM = f"""{sents("ls", "bucket", "l")},
lim AS (SELECT doc_id, sent_index, sent AS text FROM ls WHERE {cue("lower(sent)", L.LIMIT)})"""
_REF = r"(regexp_matches(lower({0}), 'doi:|https?://|\b(?:isbn|issn|pp\.|vol\.|et al\.)\b|\([0-9]{{4}}\)') OR len(regexp_extract_all({0}, '[0-9]+')) >= 6)"
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(sent), {q(p)}) THEN {q(c)}" for c, p in L.CATEGORIES) + " ELSE 'unspecified' END"
FD = f"""{sents("fs", "seeded", "text")},
fd0 AS (SELECT *, {key("sent")} AS key, {_REF.format("sent")} AS is_ref FROM fs WHERE length(sent) BETWEEN 40 AND 350),
fd1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY sent_index) AS nth, {cue("key", L.FUTURE)} AS hook, {cue("(' ' || key || ' ')", L.MODAL)} AS modal, regexp_matches(key, 'will ({"|".join(L.WILL_VERBS)})') AS will_inf FROM fd0 WHERE NOT is_ref),
fd AS (SELECT doc_id, sent AS text, {_CATEGORY} AS category, sent_index, CASE WHEN will_inf THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence, hook, modal, will_inf FROM fd1 WHERE nth = 1 AND hook AND (modal OR will_inf))"""
STEPS = """asked AS (SELECT doc_id, sent AS text, row_number() OVER (PARTITION BY doc_id ORDER BY sent_index) AS nth FROM rq),
lacking AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY sent_index) AS nth FROM lim),
st0 AS (SELECT doc_id, 0 AS part, nth, text, 'Replicate and validate the main finding in an external cohort' AS question, 0.7::DOUBLE AS expected_impact, 0.4::DOUBLE AS difficulty FROM asked WHERE nth <= 5
 UNION ALL SELECT doc_id, 1, nth, text, CASE WHEN contains(lower(text), 'small sample') THEN 'Increase sample size and rerun the analysis' ELSE 'Add the missing measurement or control' END, 0.6::DOUBLE, CASE WHEN contains(lower(text), 'small sample') THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END
 FROM lacking WHERE nth <= 5 AND (contains(lower(text), 'small sample') OR contains(lower(text), 'lack of'))),
st AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, nth)::BIGINT AS ordinal, question, expected_impact, difficulty, text AS link FROM st0)"""
TOTALS = """tot AS (SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_rq, coalesce(b.n, 0)::BIGINT AS n_lim, coalesce(c.n, 0)::BIGINT AS n_fd, (coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(c.n, 0))::BIGINT AS total_extractions
FROM seeded d LEFT JOIN (SELECT doc_id, count(*) n FROM rq GROUP BY 1) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) n FROM lim GROUP BY 1) b USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) n FROM fd GROUP BY 1) c USING (doc_id))"""
BOTH = f"{SEEDED}, {SECTIONS}, {BUCKETS}, {RQ}, {LIM}"
SIDES = "sides AS (SELECT user_id AS topic, ts, event_id, CASE event_type WHEN 'view' THEN 'data' WHEN 'click' THEN 'lit' END AS side, value AS score FROM events WHERE event_type IN ('view', 'click'))"
LATEST = f"""{SIDES}, nth AS (SELECT *, row_number() OVER (PARTITION BY topic, side ORDER BY ts DESC, event_id DESC) AS nth FROM sides),
d AS (SELECT topic, score AS feasibility_score FROM nth WHERE nth = 1 AND side = 'data'), l AS (SELECT topic, score AS significance_score FROM nth WHERE nth = 1 AND side = 'lit')"""
LATEST_OF_DAY = LATEST.replace("user_id AS topic", "user_id * 100 + day(ts) AS topic")
_counts = lambda low, phrases: "(" + " + ".join(f"contains({low}, {q(p)})::BIGINT" for p in phrases) + ")"
_vec = lambda p: "[" + ", ".join(f"{x!r}::DOUBLE" for x in p) + "]"
_cos = lambda a, b: f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0.0)"
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_ONE_LINE = r"regexp_replace(text, '[\r\n]', ' ', 'g')"

SQL = {
    "sentence_split_stats": f"WITH {SEEDED}, {sents('s', 'seeded', 'text')} SELECT lang, count(*)::BIGINT AS n_sentences, sum(length(sent))::BIGINT AS n_chars FROM s JOIN seeded USING (doc_id) GROUP BY lang",
    "section_map": f"WITH {SEEDED}, {SECTIONS} SELECT doc_id, section, length(body)::BIGINT AS n_chars, md5(body) AS digest FROM sec",
    "section_sizes": f"WITH {SEEDED}, {SECTIONS}, n AS (SELECT unnest([{', '.join(map(q, L.SECTION_NAMES))}]) AS section) SELECT section, count(doc_id)::BIGINT AS n_docs, coalesce(sum(length(body)), 0)::BIGINT AS n_chars FROM n LEFT JOIN sec USING (section) GROUP BY section",
    "research_questions": f"WITH {BOTH} SELECT doc_id, question, sent AS evidence, sent_index::BIGINT AS sent_index, 0.8::DOUBLE AS confidence, true AS hook, 'explicit_rq' AS type FROM rq",
    "limitations": f"WITH {BOTH} SELECT doc_id, text, sent_index::BIGINT AS sent_index, 0.8::DOUBLE AS confidence, 'unspecified' AS limitation_type FROM lim",
    "future_directions": f"WITH {SEEDED}, {FD} SELECT doc_id, text, category, sent_index::BIGINT AS sent_index, confidence, hook, modal, will_inf FROM fd",
    "rejected_sentences": f"WITH {SEEDED}, {FD} SELECT doc_id, sent_index::BIGINT AS sent_index, 'future_dir_reject_ref' AS reason, sent FROM fd0 WHERE is_ref UNION ALL SELECT doc_id, sent_index::BIGINT, 'future_dir_reject', sent FROM fd1 WHERE nth = 1 AND NOT (hook AND (modal OR will_inf))",
    "fd_by_category": f"WITH {SEEDED}, {FD} SELECT category, count(*)::BIGINT AS n, round(avg(confidence), 6) AS avg_confidence FROM fd GROUP BY category",
    "signal_strength": f"WITH {SEEDED}, {FD} SELECT CASE WHEN hook AND modal THEN 'moderate' ELSE 'weak' END AS strength, (hook::INT + modal::INT + will_inf::INT)::BIGINT AS signals, count(*)::BIGINT AS n FROM fd GROUP BY 1, 2",
    "actionable_fd": f"WITH {SEEDED}, {FD} SELECT doc_id, sent_index::BIGINT AS sent_index, category, confidence FROM fd WHERE category <> 'unspecified' AND length(text) > 50 AND confidence >= 0.75",
    "high_conf": f"WITH {SEEDED}, {FD} SELECT doc_id, sent_index::BIGINT AS sent_index, '{{\"hook\":' || hook || ',\"semantic\":false,\"modal\":' || modal || ',\"will_inf\":' || will_inf || '}}' AS signals FROM fd WHERE confidence >= 0.9",
    "next_steps": f"WITH {BOTH}, {STEPS} SELECT * FROM st",
    "priority_topn": f"WITH {BOTH}, {STEPS}, p AS (SELECT *, round(expected_impact * (1 - difficulty), 6) AS priority FROM st), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, ordinal)::BIGINT AS rank FROM p) SELECT doc_id, rank, question, priority FROM r WHERE rank <= 3",
    "doc_rollup": f"WITH {BOTH}, {FD}, {TOTALS} SELECT * FROM tot",
    "corpus_stats": f"WITH {BOTH}, {FD}, {TOTALS} SELECT count(*)::BIGINT AS docs, sum(n_rq)::BIGINT AS rqs, sum(n_lim)::BIGINT AS limitations, sum(n_fd)::BIGINT AS future, sum(total_extractions)::BIGINT AS total_extractions, round(sum(total_extractions) / count(*), 6) AS avg_extractions_per_doc FROM tot",
    "run_metrics": f"WITH {BOTH}, {FD}, {STEPS} SELECT (SELECT count(*) FROM seeded)::BIGINT AS docs, (SELECT count(*) FROM rq)::BIGINT AS rqs, (SELECT count(*) FROM st)::BIGINT AS steps, (SELECT count(*) FROM fd)::BIGINT AS future",
    "rule_features": f"WITH {SEEDED}, {sents('s', 'seeded', 'text')}, w AS (SELECT doc_id, sent_index, lower(sent) AS low FROM s) SELECT doc_id, sent_index::BIGINT AS sent_index, {_counts('low', [*L.FUTURE, L.COUNTED_TWICE])} AS hook_cnt, {_counts(chr(40) + q(' ') + ' || low || ' + q(' ') + chr(41), L.COUNTED_MODALS)} AS modal_cnt, regexp_matches(low, 'will ({'|'.join(L.WILL_VERBS)})')::BIGINT AS will_inf FROM w",
    "text_functions": f"WITH {SEEDED}, u AS (SELECT *, regexp_replace({strip('text')}, '\\.$', '') AS q FROM seeded) SELECT doc_id, CASE WHEN length(text) > 140 THEN substr(text, 1, 139) || '…' ELSE text END AS cut, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS preview, md5({key('text')}) AS key_digest, (length(q) + CASE WHEN ends_with(q, '?') THEN 0 ELSE 1 END)::BIGINT AS question_len, {_REF.format('text')} AS is_reference FROM u",
    "context_window": rf"WITH w AS (SELECT conv_id, turn, lag({strip('text')}) OVER o AS a, lead({strip('text')}) OVER o AS b FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, substr(regexp_replace({strip('concat_ws(' + q(' ') + ', nullif(a, ' + q('') + '), nullif(b, ' + q('') + '))')}, '[ \t\n\r\f\v]+', ' ', 'g'), 1, 600) AS context FROM w",
    "proto_match": f"WITH {_E}, b AS (SELECT vec_id, greatest(0.0, {', '.join(_cos('v', _vec(p)) for p in PROTOTYPES)}) AS best FROM e) SELECT vec_id, round(best, 6) AS best, best >= 0.25 AS matches FROM b",
    "topk_neighbors": f"WITH {_E}, p AS (SELECT a.label, a.vec_id, b.vec_id AS j, round({_cos('a.v', 'b.v')}, 12) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY c DESC, j)::BIGINT AS rank FROM p) SELECT label, vec_id, rank, round(c, 6) AS cosine FROM r WHERE rank <= 2",
    "cosine_pairs": f"WITH {_E}, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, {_cos('a.v', 'b.v')} AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT label, a, b, round(c, 6) AS cosine FROM p WHERE c >= 0.3",
    "strip_tags": "WITH s AS (SELECT page_id, replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '') AS b FROM pages) SELECT page_id, length(b)::BIGINT AS n_chars, md5(b) AS digest FROM s",
    "tei_extract": rf"WITH s AS (SELECT page_id, {strip("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, regexp_extract(html, '(?s)<abstract[^>]*>(.*?)</abstract>', 1) AS a, regexp_extract(html, '(?s)<body[^>]*>(.*?)</body>', 1) AS b, {strip("regexp_extract(html, '(?s)idno type=" + chr(34) + "DOI" + chr(34) + "[^>]*>(.*?)</idno>', 1)")} AS doi FROM pages), t AS (SELECT *, replace(regexp_replace(a, '<[^>]*(>|$)', '', 'g'), '>', '') AS x, replace(regexp_replace(b, '<[^>]*(>|$)', '', 'g'), '>', '') AS y FROM s) SELECT page_id, title, length(x)::BIGINT AS abstract_len, md5(y) AS text_digest, doi FROM t",
    "topic_match": f"WITH {LATEST} SELECT topic, round(0.6 * feasibility_score + 0.4 * significance_score, 3) AS combined FROM d JOIN l USING (topic)",
    "unmatched_data": f"WITH {LATEST_OF_DAY} SELECT * FROM d ANTI JOIN l USING (topic)",
    "unmatched_lit": f"WITH {LATEST_OF_DAY} SELECT * FROM l ANTI JOIN d USING (topic)",
    "stub_match": "SELECT unnest(['metagenomics IBD remission', 'infant microbiome antibiotic exposure', 'human gut microbiome 16S', 'microbiome antibiotics longitudinal adults', 'IBD antibiotics recovery']) AS topic, 0.788::DOUBLE AS combined, 5::BIGINT AS n_counts",
    "rps_sliding": "WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) SELECT start, count(*)::BIGINT AS n, round(count(*) / 3600.0::DOUBLE, 9) AS rps FROM w GROUP BY start",
    "match_rate": "SELECT date_trunc('hour', ts) AS start, count(*)::BIGINT AS n, round(count(*) / 3600.0::DOUBLE, 9) AS rate FROM events GROUP BY 1",
    "event_counts": "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1",
    "sparkline": """WITH n AS (SELECT user_id, ts, event_id, round(value, 4) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
        k AS (SELECT *, min(v) OVER (PARTITION BY user_id) AS lo, max(v) OVER (PARTITION BY user_id) AS hi, count(*) OVER (PARTITION BY user_id) AS c FROM n WHERE back <= 24),
        b AS (SELECT *, substr(' ▁▂▃▄▅▆▇█', floor(((v) - lo) / (hi - lo + 1e-9) * 7)::INT + 2, 1) AS bar FROM k)
        SELECT user_id, CASE WHEN max(hi) - max(lo) < 1e-9 THEN repeat('█', count(*)::INT) ELSE rpad(string_agg(bar, '' ORDER BY ts, event_id), 24, ' ') END AS bars FROM b GROUP BY user_id""",
    "enrich_left_join": "SELECT d.doc_id, lang, source, coalesce(quality, -1)::BIGINT AS quality, coalesce(toxic, 0)::BIGINT AS toxic FROM documents d LEFT JOIN labels USING (doc_id)",
    "label_clean": rf"""WITH t AS (SELECT doc_id, {_ONE_LINE} AS s FROM documents),
        l AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '"' || s || '",1' WHEN 1 THEN s || ',2' WHEN 2 THEN '# ' || s WHEN 3 THEN replace(s, ',', ';') WHEN 4 THEN chr(65279) || s || ' , 0 ' || chr(13) ELSE s || ',' END AS line FROM t),
        c AS (SELECT doc_id, rtrim(replace(line, chr(65279), ''), chr(13) || chr(10)) AS line FROM l),
        k AS (SELECT * FROM c WHERE line <> '' AND NOT starts_with({strip('line')}, '#') AND lower({strip('line')}) <> 'sentence,label'),
        p AS (SELECT doc_id, NOT contains(line, ',') AS bad, CASE WHEN contains(line, ',') THEN {strip("regexp_extract(line, '(?s)^(.*),([^,]*)$', 1)")} ELSE {strip('line')} END AS s, CASE WHEN contains(line, ',') THEN {strip("regexp_extract(line, '(?s)^(.*),([^,]*)$', 2)")} ELSE '' END AS label FROM k)
        SELECT doc_id, CASE WHEN s = '"' THEN '' WHEN starts_with(s, '"') AND ends_with(s, '"') THEN substr(s, 2, length(s) - 2) ELSE s END AS sentence, CASE WHEN label IN ('0', '1') THEN label ELSE '' END AS label, bad FROM p""",
    "labeled_examples": f"SELECT doc_id, {strip('text')} AS sentence, (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END)::BIGINT AS label FROM documents WHERE {strip('text')} <> ''",
    "report": """WITH j AS (SELECT quality AS y, 1 - toxic AS p, n_chars::DOUBLE AS s FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM j),
        c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn, sum(k) FILTER (y = 1) AS ranks, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM r)
        SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round((ranks - n1 * (n1 + 1) / 2.0) / (n1 * n0)::DOUBLE, 6) AS auc FROM c""",
    "stratified_split": "WITH n AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS nth, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, nth <= floor(n * 0.2 + 0.5) AS is_test FROM n",
    "match_fold": f"""WITH RECURSIVE {SIDES}, m AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY ts, event_id) AS i, side, score, event_id FROM sides WHERE score IS NOT NULL),
        f AS (SELECT DISTINCT topic, 0::BIGINT AS i, NULL::DOUBLE AS d, NULL::DOUBLE AS l, NULL::BIGINT AS event_id, NULL::DOUBLE AS fe, NULL::DOUBLE AS si FROM m
        UNION ALL SELECT topic, i, CASE WHEN nd IS NULL OR nl IS NULL THEN nd END, CASE WHEN nd IS NULL OR nl IS NULL THEN nl END, event_id, CASE WHEN nl IS NOT NULL THEN nd END, CASE WHEN nd IS NOT NULL THEN nl END
        FROM (SELECT m.topic, m.i, m.event_id, CASE m.side WHEN 'data' THEN m.score ELSE f.d END AS nd, CASE m.side WHEN 'lit' THEN m.score ELSE f.l END AS nl FROM f JOIN m ON m.topic = f.topic AND m.i = f.i + 1))
        SELECT topic, (row_number() OVER (PARTITION BY topic ORDER BY i) - 1)::BIGINT AS n, event_id, fe AS feasibility, si AS significance, round(0.6 * fe + 0.4 * si, 3) AS combined FROM f WHERE fe IS NOT NULL AND si IS NOT NULL""",
    "token_bucket": """WITH RECURSIVE t AS (SELECT user_id, row_number() OVER w AS i, coalesce(epoch_us(ts) / 1e6::DOUBLE - lag(epoch_us(ts) / 1e6::DOUBLE) OVER w, 0.0) AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 10.0::DOUBLE AS a, 10.0::DOUBLE AS b, 0::BIGINT AS ga, 0::BIGINT AS gb FROM t
        UNION ALL SELECT user_id, i, a - x, b - y, x, y FROM (SELECT *, CASE WHEN a >= 7 THEN 7 ELSE 0 END::BIGINT AS x, least(floor(b), 7)::BIGINT AS y FROM (SELECT t.user_id, t.i, least(10.0, f.a + t.dt * 0.1::DOUBLE) AS a, least(10.0, f.b + t.dt * 0.1::DOUBLE) AS b FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1)))
        SELECT user_id, sum(ga)::BIGINT AS granted, sum(gb)::BIGINT AS granted_part FROM f GROUP BY user_id""",
    "rate_controller": """WITH RECURSIVE h AS (SELECT date_trunc('hour', ts) AS h, count(*) FILTER (event_type = 'view') / 100.0::DOUBLE AS sd, count(*) FILTER (event_type = 'click') / 100.0::DOUBLE AS sl FROM events GROUP BY 1), o AS (SELECT row_number() OVER (ORDER BY h) AS i, sd, sl FROM h),
        f AS (SELECT 0::BIGINT AS i, 4.0::DOUBLE AS d, 2.0::DOUBLE AS l UNION ALL
        SELECT o.i, (CASE WHEN sd > 1.3 * sl THEN d * 0.85 WHEN sl > 1.3 * sd THEN least(d * 1.15, l * 0.85 * 1.1 + 0.5) ELSE d END) * CASE WHEN sd > 0.2 AND sl > 0.2 THEN 1.05 ELSE 1 END,
        (CASE WHEN sd > 1.3 * sl THEN least(l * 1.15, d * 0.85 * 1.1 + 0.5) WHEN sl > 1.3 * sd THEN l * 0.85 ELSE l END) * CASE WHEN sd > 0.2 AND sl > 0.2 THEN 1.05 ELSE 1 END FROM f JOIN o ON o.i = f.i + 1)
        SELECT (i - 1)::BIGINT AS n, round(d, 6) AS data_rate, round(l, 6) AS lit_rate FROM f WHERE i > 0""",
}
