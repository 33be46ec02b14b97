"""SQL of the queries in ``records`` and of the streams."""

from __future__ import annotations

from ..functions import lexicon as L
from ..operators.steps import STEPS as STEP_TEXTS
from .records import LETTERS, SIMILAR_LETTERS, letters_of
from .sql import _CATEGORY, _REF, BOTH, BUCKETS, FD, LIM, RQ, SECTIONS, SEEDED, SIDES, STEPS, cue, key, q, sents, strip
from .sql import SQL as BASE

PAPERS = "papers AS (SELECT doc_id, 'Paper ' || doc_id % 97 AS title, concat_ws(' ', lang, source) AS abstract, text, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || doc_id ELSE '' END AS doi FROM seeded)"
_SIGNALS = "'{{\"hook\":' || {0} || ',\"semantic\":false,\"modal\":' || {1} || ',\"will_inf\":' || {2} || '}}'"
_body = lambda s: f"coalesce(max(body) FILTER (section = '{s}'), '')"
_step = lambda i: "CASE question " + " ".join(f"WHEN {q(t[0])} THEN {q(t[i])}" for t in STEP_TEXTS.values()) + " END"
FULL = f"{SEEDED}, {PAPERS}, {SECTIONS}, {BUCKETS}, {RQ}, {LIM}, {FD}, {STEPS}"
_ABBREVIATED = r"regexp_replace(text, '(^|[^0-9A-Za-z_])(Dr|Mr|Mrs|Ms|Prof|Fig|Figs|Eq|No|Vol|vs|cf|al|etc|approx|St|e\.g|i\.e)\.', '\1\2' || chr(1), 'g')"
_SMART = rf"list_filter(list_transform(string_split(regexp_replace({_ABBREVIATED}, '([.!?]+)([ \t\n\r\f\v]|$)', '\1' || chr(2) || '\2', 'g'), chr(2)), lambda x: {strip('replace(x, chr(1), ' + q('.') + ')')}), lambda x: x <> '')"
_WILL = f"regexp_matches(key, 'will ({'|'.join(L.WILL_VERBS)})')"
#: The first sentence of each key, before any gate.
FIRST = f"""{sents("fs", "seeded", "text")},
c0 AS (SELECT *, {key("sent")} AS key FROM fs WHERE length(sent) BETWEEN 40 AND 350),
c1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY sent_index) AS nth, {cue("key", L.FUTURE)} AS hook, {cue("(' ' || key || ' ')", L.MODAL)} AS modal, {_WILL} AS will_inf, {_CATEGORY} AS category FROM c0 WHERE NOT {_REF.format("sent")}),
first AS (SELECT * FROM c1 WHERE nth = 1)"""
_letters = "[" + ", ".join(f"(length(low) - length(replace(low, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
_like = lambda p: f"list_dot_product(v, {p!r}::DOUBLE[]) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({p!r}::DOUBLE[], {p!r}::DOUBLE[])), 0)"
_CUT = lambda x: f"CASE WHEN length({x}) > 140 THEN substr({x}, 1, 139) || '…' ELSE {x} END"
_three = lambda src, order, text, name: f"{name} AS (SELECT doc_id, string_agg({_CUT('t')}, '|' ORDER BY n) AS {name} FROM (SELECT doc_id, {text} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS n FROM {src}) WHERE n <= 3 GROUP BY doc_id)"

RECORDS_SQL = {
    "paper_fields": f"WITH {SEEDED}, {PAPERS} SELECT doc_id, CASE WHEN doi <> '' THEN doi ELSE title END AS identifier, md5({strip('(abstract || chr(10) || text)')}) AS base_digest, md5('Title: ' || title || '. Abstract: ' || abstract) AS summary_digest FROM papers",
    "section_access": f"WITH {SEEDED}, {SECTIONS}, w AS (SELECT d.doc_id, {', '.join(f'{_body(s)} AS {s}' for s in L.SECTION_NAMES)} FROM seeded d LEFT JOIN sec USING (doc_id) GROUP BY d.doc_id) SELECT doc_id, length(methods)::BIGINT AS methods, 0::BIGINT AS nothing, md5(concat_ws(chr(10), nullif(introduction, ''), nullif(related, ''))) AS question_digest, md5(concat_ws(chr(10), nullif(discussion, ''), nullif(conclusion, ''), nullif(limitations, ''), nullif(future, ''))) AS future_digest FROM w",
    "openalex_fields": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN doc_id END AS k FROM documents)
        SELECT doc_id, 'W' || k AS openalex_id, 'Work ' || k AS title_oa, coalesce(1990 + k % 30, -1)::BIGINT AS year, coalesce(CASE WHEN k % 4 > 0 THEN k % 500 END, 0)::BIGINT AS citations, CASE WHEN k IS NOT NULL THEN array_to_string(list_transform(range(1, least(k % 14 + 1, 10) + 1), lambda i: 'c' || i), ',') END AS concepts, CASE WHEN k IS NULL THEN -1 ELSE least(k % 25 + 1, 20) END::BIGINT AS n_related, 'A' || k % 7 || ',B' AS authors, k IS NOT NULL AS has_openalex FROM d""",
    "enriched": f"WITH {SEEDED}, {PAPERS} SELECT p.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'W' || l.doc_id END AS openalex_id, coalesce(CASE WHEN l.doc_id % 4 > 0 THEN l.doc_id % 500 END, 0)::BIGINT AS citations, 0::BIGINT AS n_embedding, 0::BIGINT AS n_entities FROM papers p LEFT JOIN labels l ON p.doi = '10.1/' || l.doc_id",
    "question_labels": f"WITH {BOTH} SELECT doc_id, sent_index::BIGINT AS sent_index, 'RQ[0.80]: ' || substr(question, 1, 80) || '...' AS label FROM rq",
    "record_round_trip": f"WITH {SEEDED}, {FD} SELECT doc_id, sent_index::BIGINT AS sent_index, 'future_direction' AS type, text, category, confidence, CASE WHEN hook AND modal THEN 'moderate' ELSE 'weak' END AS strength, (hook::INT + modal::INT + will_inf::INT)::BIGINT AS n_signals, false AS has_context, true AS no_classifier FROM fd",
    "future_by_model": f"WITH {SEEDED}, {FIRST}, m AS (SELECT *, length(sent) % 100 / 100.0::DOUBLE AS ml FROM first), k AS (SELECT *, CASE WHEN will_inf OR ml >= 0.85 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM m WHERE hook AND (modal OR will_inf) AND ml >= 0.4) SELECT doc_id, sent_index::BIGINT AS sent_index, confidence, CASE WHEN ml > 0.85 THEN 'strong' WHEN hook AND modal THEN 'moderate' ELSE 'weak' END AS strength, (hook::INT + modal::INT + will_inf::INT + (ml > 0.7)::INT)::BIGINT AS n_signals, category <> 'unspecified' AND length(sent) > 50 AS actionable FROM k",
    "decision_scores": "SELECT doc_id, round(1 / (1 + exp(-((n_chars - 2000) / 1000.0::DOUBLE))), 9) AS probability FROM documents",
    "entity_labels": "WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT user_id, coalesce(string_agg(DISTINCT upper(event_type), ',' ORDER BY upper(event_type)) FILTER (event_type <> 'error' AND r <= 100), '') AS labels FROM n GROUP BY user_id",
    "malformed_lines": f"SELECT count(*) FILTER (bad)::BIGINT AS bad, count(*)::BIGINT AS lines, count(*) FILTER (label = '')::BIGINT AS without_label FROM ({BASE['label_clean']})",
    "smart_sentences": f"WITH {SEEDED}, s AS (SELECT doc_id, {_SMART} AS l FROM seeded) SELECT doc_id, unnest(range(len(l)))::BIGINT AS sent_index, unnest(l) AS sent FROM s",
    "paper_lines": f"""WITH {SEEDED}, {PAPERS}, g AS (SELECT doc_id::VARCHAR AS title, CASE WHEN doc_id % 7 > 0 THEN text ELSE abstract || ' ' || doc_id END AS text, abstract, CASE WHEN doc_id % 2 > 0 THEN doi ELSE '' END AS doi FROM papers WHERE doc_id % 11 > 0 AND doc_id % 13 > 0)
        SELECT title, md5(text || '|' || abstract || '|' || doi) AS text_digest, 'read' AS kind FROM g UNION ALL SELECT '', md5('{{broken ' || doc_id), 'broken' FROM papers WHERE doc_id % 11 = 0""",
    "summary_markdown": f"""WITH {FULL},
        nq AS (SELECT doc_id, string_agg(n || '. ' || question || chr(10) || '   - Identified by: ' || {_SIGNALS.format("'true'", "'false'", "'false'")} || chr(10), '' ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_index) AS n FROM rq) GROUP BY doc_id),
        nl AS (SELECT doc_id, string_agg(n || '. ' || text || chr(10) || '   - Confidence: 0.80' || chr(10), '' ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_index) AS n FROM lim) GROUP BY doc_id),
        ns AS (SELECT doc_id, string_agg(ordinal || '. ' || question || chr(10) || '   - Rationale: ' || {_step(1)} || chr(10) || '   - Approach: ' || {_step(2)} || chr(10) || '   - Expected Impact: ' || expected_impact || chr(10) || '   - Difficulty: ' || difficulty || chr(10), '' ORDER BY ordinal) AS x FROM st GROUP BY doc_id),
        nf AS (SELECT doc_id, string_agg(n || '. [' || category || '] ' || text || chr(10) || '   - Identified by: ' || {_SIGNALS.format("hook", "modal", "will_inf")} || chr(10), '' ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_index) AS n FROM fd) WHERE n <= 10 GROUP BY doc_id),
        md AS (SELECT p.doc_id, '# ' || title || chr(10) || CASE WHEN doi <> '' THEN 'DOI: ' || doi || chr(10) ELSE '' END || {" || ".join(f"'## {t}' || chr(10) || coalesce({c}.x, 'None detected.' || chr(10)) || chr(10)" for t, c in (("Explicit Research Questions", "nq"), ("Limitations", "nl"), ("Proposed Next Steps", "ns"), ("Future Directions Mined From the Paper", "nf")))} || '---' || chr(10) AS m
        FROM papers p LEFT JOIN nq USING (doc_id) LEFT JOIN nl USING (doc_id) LEFT JOIN ns USING (doc_id) LEFT JOIN nf USING (doc_id)) SELECT doc_id, length(m)::BIGINT AS n_chars, md5(m) AS digest FROM md""",
    "first_papers": f"""WITH {FULL}, {_three("rq", "sent_index", "question", "questions")}, {_three("fd", "sent_index", "'[' || category || '] ' || text", "future")}, {_three("st", "ordinal", "question", "steps")}, five AS (SELECT doc_id, title AS header FROM papers ORDER BY doc_id LIMIT 5)
        SELECT five.doc_id, header, coalesce(questions, '') AS questions, coalesce(future, '') AS future, coalesce(steps, '') AS steps FROM five LEFT JOIN questions USING (doc_id) LEFT JOIN future USING (doc_id) LEFT JOIN steps USING (doc_id)""",
    "attributed": f"WITH {BOTH}, {PAPERS} SELECT title, count(*)::BIGINT AS n, md5(string_agg(lim.text, '|' ORDER BY doc_id, sent_index)) AS digest FROM lim JOIN papers USING (doc_id) GROUP BY title",
    "wire_events": f"WITH {BOTH} SELECT doc_id, sent_index::BIGINT AS sent_index, text FROM lim",
    "similar_context": f"WITH t AS ({BASE['topk_neighbors']}), s AS (SELECT label, vec_id, j, rank FROM (SELECT a.label, a.vec_id, b.vec_id AS j, row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY round(list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0), 12) DESC, b.vec_id) AS rank FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 2), g AS (SELECT label, vec_id, string_agg('v' || j, ' ' ORDER BY rank) AS s FROM s GROUP BY ALL), n AS (SELECT label, vec_id, lag(vec_id) OVER w AS a, lead(vec_id) OVER w AS b FROM x WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT label, vec_id, concat_ws(' ', 'v' || a, 'v' || b, s) AS context FROM n LEFT JOIN g USING (label, vec_id)".replace(f"t AS ({BASE['topk_neighbors']})", "x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"),
    "semantic_future": f"WITH {SEEDED}, {FIRST}, w AS (SELECT *, lower(sent) AS low FROM first), v AS (SELECT *, {_letters} AS v FROM w), m AS (SELECT *, greatest(0.0, {', '.join('coalesce(' + _like(letters_of(t)) + ', 0.0)' for t in L.PROTOTYPES['future'])}) >= {SIMILAR_LETTERS} AS semantic FROM v) SELECT doc_id, sent_index::BIGINT AS sent_index, category, CASE WHEN will_inf OR semantic THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence, semantic, CASE WHEN will_inf AND semantic THEN 'strong' WHEN hook AND modal THEN 'moderate' ELSE 'weak' END AS strength FROM m WHERE semantic OR (hook AND (modal OR will_inf))",
    "preview_lines": f"SELECT doc_id, length({strip('(doc_id || ' + q(' ') + ' || replace(regexp_replace(text, ' + q('[' + chr(92) + 'r' + chr(92) + 'n]') + ', ' + q(' ') + ', ' + q('g') + '), chr(34), chr(39)))')})::BIGINT AS n_chars, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS label FROM documents WHERE text IS NOT NULL",
    "match_stream": f"""WITH RECURSIVE {SIDES}, m AS (SELECT topic, epoch_us(ts) AS seq, row_number() OVER (PARTITION BY topic ORDER BY ts) AS i, side, score, event_id FROM sides WHERE score IS NOT NULL),
        f AS (SELECT DISTINCT topic, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::DOUBLE AS d, NULL::DOUBLE AS l, NULL::BIGINT AS de, NULL::BIGINT AS le, false AS hit FROM m
        UNION ALL SELECT m.topic, m.i, m.seq, CASE WHEN side = 'data' THEN score WHEN NOT hit THEN f.d END, CASE WHEN side = 'lit' THEN score WHEN NOT hit THEN f.l END, CASE WHEN side = 'data' THEN event_id WHEN NOT hit THEN f.de END, CASE WHEN side = 'lit' THEN event_id WHEN NOT hit THEN f.le END, NOT hit AND ((side = 'data' AND f.l IS NOT NULL) OR (side = 'lit' AND f.d IS NOT NULL))
        FROM f JOIN m ON m.topic = f.topic AND m.i = f.i + 1)
        SELECT topic::VARCHAR AS topic, seq, d AS feasibility, l AS significance, round(0.6 * d + 0.4 * l, 3) AS combined, de AS data_event, le AS lit_event FROM f WHERE hit""",
    "rps_stream": f"SELECT * FROM ({BASE['rps_sliding']}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "match_rate_stream": f"SELECT * FROM ({BASE['match_rate']}) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
}
