"""DuckDB SQL that gives the rows of the queries, written apart from them."""

from __future__ import annotations

from .functions.syllables import ABBREVIATIONS, MARKED, PATTERNS, placed
from .operators.detectors import REFUSALS, UNSAFE
from .operators.judge import SYSTEM_PROMPT, USER_PROMPT
from .queries import WEIGHTS
from .sources.inputs import DETECTORS, ODD_RESPONSES

_PERCENTILES = {"semantic_similarity": 99.5, "readability_mismatch": 95.0, "repetition": 1.0, "length_ratio": 5.0, "refusal_bias": 99.0, "unsafe_prompt": 99.0, "llm_judge": 99.5}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PAIRS = """
pairs AS (
  SELECT c.i AS dataset_index,
         (CASE WHEN c.i % 13 = 5 THEN 'how to kill time. ' WHEN c.i % 26 = 7 THEN 'how to hack and torture a model. ' ELSE '' END) || b.text AS prompt,
         (CASE WHEN c.i % 11 = 4 THEN 'I cannot help with that. ' WHEN c.i % 17 = 6 THEN 'As an AI, I won''t. ' ELSE '' END) || c.text AS chosen,
         CASE WHEN c.i % 22 = 4 THEN 'Sure, here you go.' ELSE r.text END AS rejected
  FROM (SELECT doc_id // 2 AS i, text FROM documents WHERE doc_id % 2 = 0) c
  JOIN (SELECT doc_id // 2 AS i, text FROM documents WHERE doc_id % 2 = 1) r ON r.i = c.i
  JOIN benchmark b ON b.item_id = c.i % (SELECT count(*) FROM benchmark)
), examples AS (SELECT dataset_index + 1 AS id, * FROM pairs)"""

_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
TOKENS = PAIRS + f""", tok AS (
  SELECT dataset_index AS example_id, *, {_WORDS.format("chosen")} AS cw, {_WORDS.format("rejected")} AS rw,
         {_WORDS.format("lower(chosen)")} AS cl, {_WORDS.format("lower(rejected)")} AS rl FROM pairs
)"""

TRANSCRIPTS = """
ans AS (SELECT conv_id, arg_min(text, turn) AS first_text, max(turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
lines AS (
  SELECT c.conv_id, c.turn, t.tag || c.text AS line, t.tag || CASE WHEN c.turn = a.last_turn THEN a.first_text ELSE c.text END AS swapped
  FROM conversations c LEFT JOIN ans a USING (conv_id), LATERAL (SELECT CASE role WHEN 'user' THEN 'Human: ' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END AS tag) t
), transcripts AS (
  SELECT conv_id AS dataset_index, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS chosen, string_agg(swapped, chr(10) || chr(10) ORDER BY turn) AS rejected
  FROM lines GROUP BY conv_id
), raw AS (
  SELECT dataset_index, CASE WHEN dataset_index % 10 <> 3 THEN chosen END AS chosen, CASE WHEN dataset_index % 20 <> 7 THEN rejected END AS rejected FROM transcripts
)"""


def _turns(name: str, source: str, column: str) -> str:
    return rf""", {name} AS (
  SELECT dataset_index, pos, lower(roles[pos + 1]) AS role, trim(parts[pos + 2], ' ' || chr(9) || chr(10) || chr(13)) AS content
  FROM (SELECT *, unnest(range(len(roles))) AS pos FROM (
    SELECT dataset_index, regexp_extract_all(chr(10) || {column}, '\n(Human|Assistant):', 1) AS roles,
           regexp_split_to_array(chr(10) || {column}, '\n(?:Human|Assistant):\s*') AS parts FROM {source} WHERE {column} IS NOT NULL))
)"""


_CHOSEN = TRANSCRIPTS + _turns("turns", "transcripts", "chosen")
_PARSED = (
    TRANSCRIPTS
    + _turns("ct", "raw", "chosen")
    + _turns("rt", "raw", "rejected")
    + """, parsed AS (
  SELECT dataset_index, chosen AS chosen_full, rejected AS rejected_full,
         coalesce((SELECT arg_max(content, pos) FROM ct WHERE ct.dataset_index = raw.dataset_index AND role = 'assistant'), '') AS chosen_last_assistant,
         coalesce((SELECT arg_max(content, pos) FROM rt WHERE rt.dataset_index = raw.dataset_index AND role = 'assistant'), '') AS rejected_last_assistant,
         coalesce((SELECT arg_max(content, pos) FROM ct WHERE ct.dataset_index = raw.dataset_index AND role = 'human'), '') AS prompt
  FROM raw WHERE chosen IS NOT NULL AND rejected IS NOT NULL
)"""
)

_NAMES = ", ".join(f"({d}, '{name}', {_PERCENTILES[name]})" for d, name in enumerate(DETECTORS))
HISTORY = (
    PAIRS
    + f""", det(d, detector_name, percentile) AS (VALUES {_NAMES}),
runs AS (
  SELECT d * 3 + k AS id, detector_name, 0.5 + 0.05 * d AS threshold, percentile AS percentile_used, (SELECT count(*) FROM examples) AS total_examples,
         TIMESTAMP '2026-01-01' + to_hours(d * 10 + k) AS started_at,
         CASE WHEN k < 3 AND d < {len(DETECTORS) - 1} THEN TIMESTAMP '2026-01-01' + to_hours(d * 10 + k + 1) END AS completed_at
  FROM det, range(1, 4) AS r(k)
), signals AS (
  SELECT id AS example_id, d * 3 + k AS run_id, detector_name, ((id * 7 + d * 13 + k * 29) % 100) / 100.0::DOUBLE AS score,
         (id * 7 + d * 13 + k * 29) % 100 >= d + 90 AS flagged, CASE WHEN id % 4 <> 0 THEN '{{"n":' || id || '}}' END AS metadata
  FROM examples, det, range(1, 4) AS r(k)
), latest AS (
  SELECT * FROM runs WHERE completed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY detector_name ORDER BY completed_at DESC, id DESC) = 1
), anyflag AS (
  SELECT DISTINCT s.example_id FROM signals s JOIN latest l ON l.id = s.run_id WHERE s.flagged
)"""
)

REVIEWS = """
log AS (
  SELECT doc_id + 1 AS example_id, CASE doc_id % 3 WHEN 0 THEN 'semantic_similarity' WHEN 1 THEN 'readability_mismatch' ELSE 'repetition' END AS detector_name,
         CASE WHEN toxic = 1 THEN 'true_positive' WHEN quality = 1 THEN 'false_positive' ELSE 'needs_review' END AS label, TIMESTAMP '2026-01-01' + to_seconds(doc_id) AS updated_at
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL
  UNION ALL
  SELECT doc_id + 1, CASE doc_id % 3 WHEN 0 THEN 'semantic_similarity' WHEN 1 THEN 'readability_mismatch' ELSE 'repetition' END,
         CASE WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END, TIMESTAMP '2026-01-02' + to_seconds(doc_id)
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id % 5 = 0
), reviews AS (
  SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY example_id, detector_name ORDER BY updated_at DESC, label DESC) = 1
), counts AS (
  SELECT detector_name, count(*) FILTER (label = 'true_positive') AS true_positive, count(*) FILTER (label = 'false_positive') AS false_positive,
         count(*) FILTER (label = 'needs_review') AS needs_review FROM reviews GROUP BY detector_name
)"""

_F32 = "CAST(CAST({0} AS FLOAT) AS DOUBLE)"
_RATIO = "CASE WHEN greatest(len(cw), len(rw)) = 0 THEN 1.0 ELSE least(len(cw), len(rw))::DOUBLE / greatest(len(cw), len(rw), 1) END"
_UNIQUE = "CASE WHEN len({0}) = 0 THEN 1.0 ELSE len(list_distinct({0}))::DOUBLE / len({0}) END"
_GRADE = "CASE WHEN len({1}) > 0 THEN 0.39::DOUBLE * len({1}) / {2}_sentences + 11.8::DOUBLE * {2}_syllables / len({1}) ELSE 0 END - 15.59::DOUBLE"
_CLOSED = "[)\\]}\"''”’»]*$"


def _reading(source: str, key: str, tokens: dict[str, str]) -> str:
    """CTE reading: the key, and NAME_syllables and NAME_sentences of the words in the columns ``tokens`` of a table.

    Patterns are joined with the pieces of each distinct word; sentences are seen from neighbouring words.
    """
    table = ", ".join(f"('{before + behind}', {len(before)}, {priority})" for before, priority, behind in map(placed, PATTERNS))
    every = " UNION ALL ".join(f"SELECT {key} AS id, '{name}' AS side, unnest({column}) AS w FROM {source}" for name, column in tokens.items())
    short = "|".join(ABBREVIATIONS)

    def ends(w: str, i: str) -> str:
        single = rf"regexp_matches({w}[{i}], '(^|[^.!?…])\.{_CLOSED}') AND regexp_matches({w}[{i}], '(^|[^\p{{L}}])((?i:{short})|\p{{L}})\.{_CLOSED}')"
        return f"regexp_matches({w}[{i}], '[.!?…]{_CLOSED}') AND NOT ({single})"

    def counted(w: str) -> str:
        inside = rf"len(list_filter(range(1, len({w}) + 1), lambda i: {ends(w, 'i')} AND (i = len({w}) OR NOT regexp_matches({w}[i + 1], '^\p{{Ll}}'))))"
        return f"{inside} + CASE WHEN len({w}) > 0 AND {ends(w, f'len({w})')} THEN 0 ELSE 1 END"

    sums = ", ".join(f"coalesce((SELECT n FROM spoken s WHERE s.id = {key} AND s.side = '{name}'), 0) AS {name}_syllables, {counted(column)} AS {name}_sentences" for name, column in tokens.items())
    return f""", pat(letters, place, priority) AS (VALUES {table}),
every AS ({every}),
padded AS (SELECT w, '.' || regexp_replace(translate(lower(w), '{MARKED[0]}', '{MARKED[1]}'), '[^a-z]', '.', 'g') || '.' AS p FROM (SELECT DISTINCT w FROM every)),
pieces AS (SELECT w, pos, substr(p, pos, size) AS letters FROM (SELECT w, p, unnest(range(1, length(p) + 1)) AS pos FROM padded), range(1, 13) AS r(size) WHERE pos + size <= length(p) + 1),
tops AS (SELECT w, pos + place AS spot, max(priority) AS top FROM pieces JOIN pat USING (letters) GROUP BY ALL),
cores AS (SELECT w, greatest(count(*) FILTER (top % 2 = 1), 1) AS n FROM tops GROUP BY w),
spoken AS (SELECT id, side, sum(coalesce(n, 1)) AS n FROM every LEFT JOIN cores USING (w) GROUP BY id, side),
reading AS (SELECT *, {sums} FROM {source})"""


_BOTH = {"chosen": "cw", "rejected": "rw"}
GRADED = TOKENS + _reading("tok", "example_id", _BOTH)


def _ngram(tokens: str, n: int) -> str:
    grams = f"list_transform(range(1, len({tokens}) - {n} + 2), lambda k: array_to_string({tokens}[k:k + {n - 1}], ' '))"
    return f"CASE WHEN len({tokens}) < {n} THEN 0.0 ELSE (len({tokens}) - {n - 1} - len(list_distinct({grams})))::DOUBLE / (len({tokens}) - {n - 1}) END"


def _any(column: str, patterns) -> str:
    return "regexp_matches(" + column + ", " + _quoted("(?i)" + "|".join(f"(?:{p})" for p in patterns)) + ")"


_REFUSAL = _any("chosen", REFUSALS)
_CATEGORIES = "list_filter([" + ", ".join(f"CASE WHEN {_any('prompt', p)} THEN '{name}' END" for name, p in UNSAFE.items()) + "], lambda x: x IS NOT NULL)"
SCORES = {
    "length_ratio": _F32.format(_RATIO),
    "repetition": _F32.format(f"least({_UNIQUE.format('cl')}, {_UNIQUE.format('rl')})"),
    "unsafe_prompt": f"len({_CATEGORIES})::DOUBLE",
    "refusal_bias": f"CASE WHEN len(rw) >= 20 AND {_REFUSAL} THEN 1.0 ELSE 0.0 END::DOUBLE",
    "readability_mismatch": _F32.format(f"CASE WHEN least(len(cw), len(rw)) >= 10 THEN ({_GRADE.format('', 'cw', 'chosen')}) - ({_GRADE.format('', 'rw', 'rejected')}) ELSE 0.0 END"),
}
COMPARE = {"length_ratio": "<=", "repetition": "<=", "llm_judge": "<"}
FIXED = {"unsafe_prompt": "1.0", "refusal_bias": "0.5", "llm_judge": "3.0"}

EMBEDDINGS = """
vectors AS (
  SELECT a.vec_id // 2 AS example_id, CAST(CAST(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS FLOAT) AS DOUBLE) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0
)"""

_ODD = ", ".join(f"({-i}, {_quoted(r)})" for i, r in enumerate(ODD_RESPONSES, 1))
_KINDS = """CASE WHEN NOT object THEN NULL
    WHEN json_type(body, '$.{0}') IS NULL THEN 3
    WHEN json_type(body, '$.{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(trunc(CAST(json_extract_string(body, '$.{0}') AS DOUBLE)) AS INTEGER)
    WHEN json_type(body, '$.{0}') = 'BOOLEAN' THEN CASE json_extract_string(body, '$.{0}') WHEN 'true' THEN 1 ELSE 0 END
    WHEN json_type(body, '$.{0}') = 'VARCHAR' AND regexp_full_match(trim(json_extract_string(body, '$.{0}')), '[+-]?[0-9]+') THEN CAST(json_extract_string(body, '$.{0}') AS INTEGER) END AS {1}"""
JUDGE = (
    f"""
responses AS (
  SELECT event_id AS example_id, '{{"helpfulness_delta": ' || (k % 5 + 1) || ', "honest_preference": ' || (k % 4 + 2) || ', "label_confidence": ' || (k % 3 + 3) || ', "reason": "r' || k || '"}}' AS response
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  UNION ALL SELECT * FROM (VALUES {_ODD})
), bodies AS (
  SELECT example_id, body, coalesce(json_type(body) = 'OBJECT', false) AS object
  FROM (SELECT example_id, CASE WHEN response = '' THEN '{{}}' WHEN json_valid(response) THEN response END AS body FROM responses)
), dims AS (
  SELECT *, """
    + ", ".join(_KINDS.format(n, x) for n, x in (("helpfulness_delta", "h"), ("honest_preference", "p"), ("label_confidence", "c")))
    + """
  FROM bodies
), verdicts AS (
  SELECT example_id, object AND h IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL AS good, body, h, p, c FROM dims
), judged AS (
  SELECT example_id, good, body, CASE WHEN good THEN h ELSE 3 END AS helpfulness_delta, CASE WHEN good THEN p ELSE 3 END AS honest_preference, CASE WHEN good THEN c ELSE 3 END AS label_confidence FROM verdicts
)"""
)
_LEAST = "least(helpfulness_delta, honest_preference, label_confidence)"

_REWARD = lambda w, raw: f"({WEIGHTS['words']}::DOUBLE * ln(1 + len({w}l)) + {WEIGHTS['unique']}::DOUBLE * {_UNIQUE.format(w + 'w')} + {WEIGHTS['length']}::DOUBLE * ln(1 + length({raw})))"
REWARDS = TOKENS + f", gaps AS (SELECT {_REWARD('c', 'chosen')} - {_REWARD('r', 'rejected')} AS gap FROM tok)"
_EMPTIED = HISTORY + ", emptied AS (SELECT * REPLACE (CASE WHEN dataset_index % 31 = 0 THEN '' ELSE prompt END AS prompt, CASE WHEN dataset_index % 37 = 1 THEN '' ELSE rejected END AS rejected) FROM examples)"
_VALID = "prompt <> '' AND chosen <> '' AND rejected <> ''"
_LATE = "('refusal_bias', 'unsafe_prompt', 'length_ratio', 'llm_judge')"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


ORACLES: dict[str, str] = {}


def _add(name: str, ctes: str, body: str) -> None:
    ORACLES[name] = _with(ctes, body)


_add("parse_turns", _CHOSEN, "SELECT dataset_index, CAST(pos AS INTEGER) AS pos, role, content FROM turns")
_last = lambda role: f"coalesce((SELECT arg_max(content, pos) FROM turns u WHERE u.dataset_index = t.dataset_index AND role = '{role}'), '')"
_add("last_turns", _CHOSEN, f"SELECT dataset_index, {_last('assistant')} AS last_assistant, {_last('human')} AS last_human FROM transcripts t")
_text = lambda role: f"coalesce((SELECT string_agg(content, chr(10) ORDER BY pos) FROM turns u WHERE u.dataset_index = t.dataset_index AND role = '{role}'), '')"
_add("all_turn_texts", _CHOSEN, f"SELECT dataset_index, {_text('assistant')} AS assistant_text, {_text('human')} AS human_text FROM transcripts t")
_n = lambda role: f"CAST((SELECT count(*) FROM turns u WHERE u.dataset_index = t.dataset_index AND role = '{role}') AS INTEGER)"
_add("count_turns", _CHOSEN, f"SELECT dataset_index, {_n('human')} AS human, {_n('assistant')} AS assistant FROM transcripts t")
_add("word_count", TOKENS, "SELECT dataset_index, CAST(len(cw) AS INTEGER) AS chosen_words, CAST(len(rw) AS INTEGER) AS rejected_words FROM tok")

_add("source_limit", TRANSCRIPTS, "SELECT dataset_index FROM raw WHERE dataset_index < 25")
_add("ingest_examples", _PARSED, "SELECT * FROM parsed")
_add("ingest_resume_from", _PARSED, "SELECT dataset_index, chosen_last_assistant, prompt FROM parsed WHERE dataset_index >= 40")
_add("ingest_skip_existing", _PARSED, "SELECT dataset_index, chosen_last_assistant, prompt FROM parsed WHERE dataset_index % 3 <> 0")
_add("ingest_errors", TRANSCRIPTS, "SELECT dataset_index AS \"index\", 'text is null' AS error FROM raw WHERE chosen IS NULL OR rejected IS NULL")
_add("ingest_summary", TRANSCRIPTS, "SELECT count(*) AS total_processed, count(*) FILTER (dataset_index % 3 <> 0 AND chosen IS NOT NULL AND rejected IS NOT NULL) AS total_inserted, count(*) FILTER (dataset_index % 3 = 0) AS skipped, count(*) FILTER (dataset_index % 3 <> 0 AND (chosen IS NULL OR rejected IS NULL)) AS errors FROM raw WHERE dataset_index >= 5")
_add("ingest_progress", _PARSED, "SELECT count(*) AS \"count\", coalesce(max(dataset_index), -1) AS max_index FROM parsed")

_add("stream_examples", _PARSED, "SELECT * FROM parsed")
_STREAM = _PARSED + f""", tok AS (
  SELECT *, {_WORDS.format("chosen")} AS cw, {_WORDS.format("rejected")} AS rw, {_WORDS.format("lower(chosen)")} AS cl, {_WORDS.format("lower(rejected)")} AS rl
  FROM (SELECT dataset_index, prompt, chosen_last_assistant AS chosen, rejected_last_assistant AS rejected FROM parsed)
)""" + _reading("tok", "dataset_index", _BOTH)
_streams = []
for _name, _score in SCORES.items():
    if _name in FIXED:
        _streams.append(f"SELECT dataset_index, '{_name}' AS detector_name, {_score} AS score, {_score} >= {FIXED[_name]} AS flagged FROM reading")
    else:
        _at = lambda p: f"(SELECT quantile_cont({_score}, {p}) FROM reading)"  # noqa: B023, E731
        _p = _PERCENTILES[_name] / 100
        _free = f"{_score} BETWEEN {_at(max(0, round(_p - 0.01, 4)))} AND {_at(min(1, round(_p + 0.01, 4)))}"
        _streams.append(f"SELECT dataset_index, '{_name}' AS detector_name, {_score} AS score, CASE WHEN NOT ({_free}) THEN {_score} {COMPARE.get(_name, '>=')} {_at(_p)} END AS flagged FROM reading")
_add("stream_signals", _STREAM, " UNION ALL ".join(_streams))

_add("example_by_index", PAIRS, "SELECT id, dataset_index, prompt FROM examples WHERE dataset_index = 5")
_add("example_by_id", PAIRS, "SELECT id, dataset_index, prompt FROM examples WHERE id = 8")
_add("examples_page", PAIRS, "SELECT id, dataset_index, prompt FROM examples ORDER BY id LIMIT 15 OFFSET 20")
_add("all_example_ids", PAIRS, "SELECT id FROM examples")
_add("example_count", PAIRS, "SELECT count(id) AS n FROM examples")
_add("example_signals", HISTORY, "SELECT example_id AS id, run_id, detector_name, score, flagged FROM signals WHERE run_id IN (1, 4, 9)")
_add("signals_by_detector", HISTORY, "SELECT * FROM signals WHERE detector_name = 'repetition'")
_add("flagged_ids", HISTORY, "SELECT example_id FROM signals WHERE detector_name = 'repetition' AND flagged")
_add("unflagged_ids", HISTORY, "SELECT example_id FROM signals WHERE detector_name = 'repetition' AND run_id = 8 AND NOT flagged")
_add("signal_exists", HISTORY, "SELECT count(*) > 0 AS found FROM signals WHERE detector_name = 'length_ratio' AND run_id = 10 AND example_id = 17")

for _name, _score in SCORES.items():
    _short = {"readability_mismatch": "readability"}.get(_name, _name)
    _ctes, _from = (GRADED, "reading") if _name == "readability_mismatch" else (TOKENS, "tok")
    _add(f"score_{_short}", _ctes, f"SELECT example_id, {_score} AS score FROM {_from}")
    _threshold = FIXED.get(_name) or f"(SELECT quantile_cont(score, {_PERCENTILES[_name] / 100}) FROM s)"
    _add(f"run_{_short}", _ctes + f", s AS (SELECT example_id, {_score} AS score FROM {_from})", f"SELECT example_id, score, score {COMPARE.get(_name, '>=')} {_threshold} AS flagged, round({_threshold}::DOUBLE, 9) AS threshold FROM s")
_add("sql_repetition", TOKENS + f", s AS (SELECT example_id, {SCORES['repetition']} AS score FROM tok)", "SELECT example_id, score, score <= (SELECT quantile_cont(score, 0.01) FROM s) AS flagged FROM s")
_add("score_semantic_similarity", EMBEDDINGS, "SELECT * FROM vectors")
_add("run_semantic_similarity", EMBEDDINGS, "SELECT example_id, score, score >= t.threshold AS flagged, round(t.threshold, 9) AS threshold FROM vectors, (SELECT quantile_cont(score, 0.995) AS threshold FROM vectors) t")
_add("score_llm_judge", JUDGE, f"SELECT example_id, {_LEAST}::DOUBLE AS score FROM judged")
_add("run_llm_judge", JUDGE, f"SELECT example_id, {_LEAST}::DOUBLE AS score, {_LEAST} < 3 AS flagged, 3.0::DOUBLE AS threshold FROM judged")
_add("meta_llm_judge", JUDGE, f"SELECT example_id, helpfulness_delta, honest_preference, label_confidence, {_LEAST} AS min_score, good AND {_LEAST} < 3 AS judge_flagged, CASE WHEN good THEN coalesce(json_extract_string(body, '$.reason'), '') END AS reason, CASE WHEN NOT good THEN 'response is not a verdict' END AS error FROM judged")
_add("meta_length_ratio", TOKENS, f"SELECT example_id, CAST(len(cw) AS INTEGER) AS chosen_words, CAST(len(rw) AS INTEGER) AS rejected_words, {_RATIO} AS ratio FROM tok")
_add("meta_repetition", TOKENS, f"SELECT example_id, {_UNIQUE.format('cl')} AS chosen_unique_ratio, {_UNIQUE.format('rl')} AS rejected_unique_ratio, {_ngram('cl', 3)} AS chosen_ngram_rep, {_ngram('rl', 3)} AS rejected_ngram_rep, 3 AS ngram_size FROM tok")
_found = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any('chosen', [p])} THEN {_quoted(p)} END" for p in REFUSALS) + "], lambda x: x IS NOT NULL), ' & ')"
_add("meta_refusal_bias", TOKENS, f"SELECT example_id, {_REFUSAL} AS chosen_is_refusal, len(rw) >= 20 AS rejected_is_substantive, {_found} AS matched_patterns, CAST(len(rw) AS INTEGER) AS rejected_word_count FROM tok")
_add("meta_unsafe_prompt", TOKENS, f"SELECT example_id, array_to_string({_CATEGORIES}, ',') AS unsafe_categories, CAST(len({_CATEGORIES}) AS INTEGER) AS category_count FROM tok")
_add("meta_readability", GRADED, f"SELECT example_id, round({_GRADE.format('', 'cw', 'chosen')}, 9) AS chosen_grade_level, round({_GRADE.format('', 'rw', 'rejected')}, 9) AS rejected_grade_level, round(({_GRADE.format('', 'cw', 'chosen')}) - ({_GRADE.format('', 'rw', 'rejected')}), 9) AS grade_difference FROM reading")
_add("meta_semantic_similarity", EMBEDDINGS, "SELECT example_id, score AS similarity, 'all-MiniLM-L6-v2' AS model FROM vectors")
_add(
    "score_own_similarity",
    PAIRS
    + r""", texts AS (
  SELECT dataset_index * 2 AS id, lower(chosen) AS text FROM pairs UNION ALL SELECT dataset_index * 2 + 1, lower(rejected) FROM pairs
), tf AS (
  SELECT id, w, count(*) AS n FROM (SELECT id, unnest(CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN regexp_extract_all(text, '[\p{L}\p{N}]+') ELSE [''] END) AS w FROM texts) GROUP BY id, w
), hashed AS (
  SELECT w, sha256(w) AS h FROM (SELECT DISTINCT w FROM tf)
), df AS (
  SELECT h[1:5] AS bucket, count(DISTINCT id) AS n FROM tf JOIN hashed USING (w) GROUP BY bucket
), weights AS (
  SELECT w, h, floor(1024 * (ln((1 + (SELECT count(*) FROM texts)) / (1.0::DOUBLE + df.n)) + 1) + 0.5) AS idf FROM hashed JOIN df ON df.bucket = h[1:5]
), signs AS (
  SELECT w, idf, j, 2 * (((strpos('0123456789abcdef', h[j // 4 + 1]) - 1) >> (3 - j % 4)) & 1) - 1 AS s FROM weights, range(256) AS r(j)
), vectors AS (
  SELECT id, j, sum(floor(idf * (1 + ln(n)) + 0.5) * s) AS x FROM tf JOIN signs USING (w) GROUP BY id, j
)""",
    "SELECT a.id // 2 AS example_id, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 9) AS similarity FROM vectors a JOIN vectors b ON b.id = a.id + 1 AND b.j = a.j WHERE a.id % 2 = 0 GROUP BY a.id",
)
# The detectors in their order, how scores meet thresholds, constant thresholds, usual and configured percentiles.
_REGISTRY = """
(0, 'semantic_similarity', 'ge', NULL, 99.5, 99.5),
(1, 'readability_mismatch', 'ge', NULL, 99.5, 95.0),
(2, 'repetition', 'le', NULL, 0.5, 1.0),
(3, 'length_ratio', 'le', NULL, 0.5, 5.0),
(4, 'refusal_bias', 'ge', 0.5, 99.0, 99.0),
(5, 'unsafe_prompt', 'ge', 1.0, 99.0, 99.0),
(6, 'llm_judge', 'lt', 3.0, 99.5, 99.5)"""
_add(
    "detector_registry",
    HISTORY + f", known(position, name, comparison, fixed_threshold, default_percentile, percentile) AS (VALUES {_REGISTRY})",
    "SELECT position::INTEGER AS position, name, comparison, fixed_threshold::DOUBLE AS fixed_threshold, default_percentile::DOUBLE AS default_percentile, percentile::DOUBLE AS percentile, (SELECT count(*) FROM signals WHERE detector_name = name) AS signals, (SELECT count(*) FROM signals WHERE detector_name = name AND flagged) AS flagged FROM known",
)
_docs = f"d AS (SELECT doc_id, text, {_WORDS.format('text')} AS w, {_WORDS.format('lower(text)')} AS l FROM documents)"
_add("ngram_repetition", _docs, f"SELECT doc_id, {_ngram('l', 2)} AS rate2, {_ngram('l', 4)} AS rate4, {_UNIQUE.format('l')} AS unique_ratio FROM d")
_add("fk_grade", _docs + _reading("d", "doc_id", {"text": "w"}), f"SELECT doc_id, round({_GRADE.format('', 'w', 'text')}, 9) AS grade FROM reading")
# What a judge is asked with by default.
_REQUEST = f"gpt-4o-mini\n0.0\n300\nTrue\n{SYSTEM_PROMPT}\n"
_message = " || ".join(_quoted(part) + ("" if i == 3 else f" || substr({('prompt', 'chosen', 'rejected')[i]}, 1, 2000)") for i, part in enumerate(USER_PROMPT.split("%s")))
_add("judge_prompt", TOKENS, f"SELECT example_id, {_message} AS message FROM tok")
_add("judge_requests", TOKENS, f"SELECT sha256({_quoted(_REQUEST)} || message) AS request, count(*) AS pairs FROM (SELECT {_message} AS message FROM tok UNION ALL SELECT {_message} FROM tok WHERE example_id % 2 = 0) GROUP BY 1")

_LENGTHS = TOKENS + f", s AS (SELECT example_id, {SCORES['length_ratio']} AS score FROM tok)"
_STATS = "round(avg({0}), 9) AS mean, round(stddev_pop({0}), 9) AS std, round(min({0}), 9) AS min, round(max({0}), 9) AS max, " + ", ".join(f"round(quantile_cont({{0}}, {q}), 9) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p99_5", 0.995)))
_add("score_stats", _LENGTHS, f"SELECT {_STATS.format('score')} FROM s")
_add("score_percentile", _LENGTHS, " UNION ALL ".join(f"SELECT {p}::DOUBLE AS percentile, round(quantile_cont(score, {p / 100}), 9) AS value FROM s" for p in (0.0, 1.0, 37.5, 50.0, 99.9, 100.0)))
_cliff = ", ".join(f"({p}::DOUBLE, (SELECT quantile_cont(score, {p / 100}) FROM s))" for p in (50, 75, 90, 95, 99))
_add("threshold_cliff", _LENGTHS + f", v(p, x) AS (VALUES {_cliff})", "SELECT p AS percentile, round(x, 9) AS threshold_value, round(j, 9) AS jump_size FROM (SELECT p, x, abs(x - lag(x) OVER (ORDER BY p)) AS j FROM v) WHERE j IS NOT NULL ORDER BY j DESC, p LIMIT 1")
_add(
    "compare_distributions",
    _LENGTHS
    + """, n AS (
  SELECT count(*) FILTER (example_id % 3 = 0) AS n_a, count(*) FILTER (example_id % 3 <> 0) AS n_b FROM s
), k AS (
  SELECT DISTINCT score, count(*) FILTER (example_id % 3 = 0) OVER w AS a, count(*) FILTER (example_id % 3 <> 0) OVER w AS b FROM s WINDOW w AS (ORDER BY score RANGE UNBOUNDED PRECEDING)
), d AS (
  SELECT max(abs(a * n_b - b * n_a)) AS far FROM k, n
), walks(t, inside) AS (
  -- the share of the paths to the points (i, t - i) that have stayed nearer than far
  SELECT 0::BIGINT, [1.0::DOUBLE]
  UNION ALL
  SELECT t + 1, list_transform(range(least(t + 1, n_a) + 1), lambda i: CASE WHEN t + 1 - i > n_b OR abs(i * n_b - (t + 1 - i) * n_a) >= far THEN 0.0::DOUBLE
    ELSE (CASE WHEN i > 0 THEN inside[i] * i ELSE 0 END + coalesce(inside[i + 1], 0) * (t + 1 - i)) / (t + 1) END)
  FROM walks, n, d WHERE t < n_a + n_b
)""",
    "SELECT round(far / (n_a * n_b), 9) AS ks_statistic, (SELECT round(1 - inside[n_a + 1], 9) FROM walks WHERE t = n_a + n_b) AS p_value, round((SELECT avg(score) FILTER (example_id % 3 = 0) - avg(score) FILTER (example_id % 3 <> 0) FROM s), 9) AS mean_diff, round((SELECT stddev_pop(score) FILTER (example_id % 3 = 0) - stddev_pop(score) FILTER (example_id % 3 <> 0) FROM s), 9) AS std_diff, n_a, n_b FROM n, d",
)
ORACLES["compare_distributions"] = ORACLES["compare_distributions"].replace("WITH", "WITH RECURSIVE", 1)

_all = []
for _name, _score in SCORES.items():
    _threshold = FIXED.get(_name) or f"(SELECT quantile_cont({_score}, {_PERCENTILES[_name] / 100}) FROM reading)"
    _all.append(f"SELECT example_id, '{_name}' AS detector_name, round({_score}, 6) AS score, {_score} {COMPARE.get(_name, '>=')} {_threshold} AS flagged FROM reading")
_add("run_all_signals", GRADED, " UNION ALL ".join(_all))
_add("detector_run_summary", TOKENS + f", s AS (SELECT {SCORES['repetition']} AS score FROM tok), t AS (SELECT quantile_cont(score, 0.01) AS t FROM s)", f"SELECT 7::BIGINT AS id, 'repetition' AS detector_name, round(any_value(t), 9) AS threshold, 1.0::DOUBLE AS percentile_used, count(*) AS total_examples, count(*) FILTER (score <= t) AS flagged_count, {_STATS.format('score')} FROM s, t")
_add("update_run", HISTORY, "SELECT id, detector_name, CASE WHEN id = 6 THEN 0.75 ELSE threshold END::DOUBLE AS threshold, CASE WHEN id = 6 THEN 11 ELSE total_examples END AS total_examples FROM runs")
_RUNS = "* REPLACE (threshold::DOUBLE AS threshold, percentile_used::DOUBLE AS percentile_used)"
_add("latest_run", HISTORY, f"SELECT {_RUNS} FROM latest")
_add("detector_names", HISTORY, "SELECT DISTINCT detector_name FROM signals ORDER BY detector_name")
_add("detector_stats", HISTORY, "SELECT r.detector_name, r.id AS run_id, any_value(r.threshold)::DOUBLE AS threshold, count(s.run_id) AS total, count(*) FILTER (s.flagged) AS flagged, CASE WHEN count(s.run_id) > 0 THEN round(100 * (count(*) FILTER (s.flagged))::DOUBLE / count(s.run_id), 2) ELSE 0 END AS flag_rate FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY detector_name ORDER BY started_at DESC, id DESC) = 1) r LEFT JOIN signals s ON s.run_id = r.id GROUP BY r.detector_name, r.id")
_add("flagged_any", HISTORY, "SELECT * FROM anyflag")
_add("clean_ids", HISTORY, "SELECT id FROM examples WHERE id NOT IN (SELECT example_id FROM anyflag)")
_add("clean_ids_excluding", HISTORY, "SELECT id FROM examples WHERE id NOT IN (SELECT s.example_id FROM signals s JOIN latest l ON l.id = s.run_id WHERE s.flagged AND s.detector_name NOT IN ('repetition', 'unsafe_prompt'))")
_add("quality_report", HISTORY, f"SELECT d.detector_name, CASE WHEN any_value(l.id) IS NULL THEN 'not_run' ELSE 'complete' END AS status, round(any_value(l.threshold)::DOUBLE, 9) AS threshold, round(any_value(l.percentile_used)::DOUBLE, 9) AS percentile_used, CASE WHEN any_value(l.id) IS NOT NULL THEN count(s.run_id) END AS total_scored, CASE WHEN any_value(l.id) IS NOT NULL THEN count(*) FILTER (s.flagged) END AS flagged, CASE WHEN count(s.run_id) > 0 THEN round(100 * (count(*) FILTER (s.flagged))::DOUBLE / count(s.run_id), 2) END AS flagged_pct, {_STATS.format('s.score')}, strftime(any_value(l.completed_at), '%Y-%m-%dT%H:%M:%S') AS completed_at FROM det d LEFT JOIN latest l USING (detector_name) LEFT JOIN signals s ON s.run_id = l.id GROUP BY d.detector_name")
_TOTALS = "(SELECT count(*) FROM examples) AS total_examples, (SELECT count(*) FROM anyflag) AS flagged_any, (SELECT count(*) FROM examples) - (SELECT count(*) FROM anyflag) AS clean_examples"
_add("quality_totals", HISTORY, f"SELECT {_TOTALS}")
_add("experiments", HISTORY, f"SELECT *, CASE WHEN total_examples > 0 THEN round(100 * clean_examples::DOUBLE / total_examples, 2) ELSE 0 END AS clean_pct FROM (SELECT {_TOTALS})")
_add("export_flagged", HISTORY, "SELECT DISTINCT e.dataset_index FROM examples e JOIN signals s ON s.example_id = e.id WHERE s.flagged AND s.detector_name <> 'repetition' ORDER BY 1")
_add("flagged_explorer", HISTORY, "SELECT s.example_id, e.dataset_index, e.prompt, e.chosen, e.rejected, round(s.score, 4) AS score, coalesce(s.metadata, '{}') AS metadata FROM signals s JOIN latest l ON l.id = s.run_id JOIN examples e ON e.id = s.example_id WHERE s.flagged AND s.detector_name = 'length_ratio' ORDER BY s.example_id LIMIT 20")

_add("explorer_by_metadata", HISTORY, "SELECT s.example_id, s.example_id - 1 AS dataset_index, round(s.score, 4) AS score, s.metadata FROM signals s JOIN latest l ON l.id = s.run_id WHERE s.flagged AND s.detector_name = 'repetition' AND CAST(json_extract_string(s.metadata, '$.n') AS BIGINT) BETWEEN 10 AND 300 ORDER BY s.example_id LIMIT 200")

_reports, _stored = [], []
for _name, _score in SCORES.items():
    _threshold = FIXED.get(_name) or f"quantile_cont({_score}, {_PERCENTILES[_name] / 100})"
    _one = f"(SELECT {_score} AS score FROM reading), (SELECT ({_threshold})::DOUBLE AS t FROM reading LIMIT 1)"
    _flags = f"count(*) FILTER (score {COMPARE.get(_name, '>=')} t)"
    _reports.append(f"SELECT '{_name}' AS detector_name, 'complete' AS status, round(any_value(t), 9) AS threshold, count(*) AS total_scored, {_flags} AS flagged, round(100 * {_flags}::DOUBLE / count(*), 2) AS flagged_pct, round(avg(score), 9) AS mean, round(quantile_cont(score, 0.9), 9) AS p90 FROM {_one}")
    _changed = ("0.75::DOUBLE", "3::BIGINT") if _name == "repetition" else ("round(any_value(t), 9)", _flags)
    _stored.append(f"SELECT '{_name}' AS detector_name, {_changed[0]} AS threshold, {_PERCENTILES[_name]}::DOUBLE AS percentile_used, count(*) AS total_examples, {_changed[1]} AS flagged_count FROM {_one}")
_reports += [f"SELECT '{n}', 'not_run', NULL, NULL, NULL, NULL, NULL, NULL" for n in DETECTORS if n not in SCORES]
_add("engine_report", _STREAM, " UNION ALL ".join(_reports))
_add("engine_runs", _STREAM, " UNION ALL ".join(_stored))

_add("upsert_review", REVIEWS, "SELECT * FROM reviews")
_add("submit_review", REVIEWS, "SELECT example_id, detector_name, label FROM (SELECT * FROM log UNION ALL SELECT * FROM (VALUES (1, 'repetition', 'false_positive', TIMESTAMP '2026-02-01'), (4, 'semantic_similarity', 'needs_review', TIMESTAMP '2026-02-01'))) QUALIFY row_number() OVER (PARTITION BY example_id, detector_name ORDER BY updated_at DESC, label DESC) = 1")
_add("reviews_for_examples", HISTORY + "," + REVIEWS, "SELECT example_id, label FROM reviews WHERE detector_name = 'semantic_similarity' AND example_id IN (SELECT example_id FROM signals WHERE run_id = 2 AND flagged)")
_add("review_stats", REVIEWS, "SELECT *, 0::BIGINT AS other FROM counts")
_add("reviewer_precision", REVIEWS, "SELECT *, true_positive + false_positive + needs_review AS total, CASE WHEN true_positive + false_positive > 0 THEN round(100 * true_positive::DOUBLE / (true_positive + false_positive), 1) END AS precision FROM counts")

_add("review_cube", REVIEWS, "SELECT detector_name, label, count(*) AS n FROM reviews GROUP BY CUBE (detector_name, label)")
_add("review_thresholds", HISTORY + "," + REVIEWS, "SELECT l.example_id, l.detector_name, l.label, l.updated_at, r.id AS run_id, r.threshold::DOUBLE AS threshold FROM log l ASOF LEFT JOIN (SELECT * FROM runs WHERE completed_at IS NOT NULL) r ON l.detector_name = r.detector_name AND l.updated_at >= r.completed_at")
_add(
    "flag_set_sizes",
    HISTORY + ", f AS (SELECT s.detector_name, s.run_id, s.example_id FROM signals s JOIN latest l ON l.id = s.run_id WHERE s.flagged), n AS (SELECT example_id, count(*) AS n FROM f GROUP BY example_id)",
    "SELECT l.detector_name, l.id AS run_id, count(f.example_id) AS flagged, (SELECT count(*) FROM n) AS flagged_any, (SELECT count(*) FROM n) - count(*) FILTER (n.n = 1) AS flagged_without, count(*) FILTER (n.n = 1) AS flagged_only, count(*) FILTER (n.n > 1) AS flagged_also FROM latest l LEFT JOIN f ON f.run_id = l.id LEFT JOIN n USING (example_id) GROUP BY l.detector_name, l.id",
)

_add("training_from_db", HISTORY, "SELECT id, prompt, chosen, rejected FROM examples WHERE id IN (SELECT example_id FROM signals WHERE run_id = 5 AND NOT flagged)")
_add("training_pairs_clean", _EMPTIED, f"SELECT dataset_index, prompt, chosen, rejected FROM emptied WHERE {_VALID} AND id NOT IN (SELECT s.example_id FROM signals s JOIN latest l ON l.id = s.run_id WHERE s.flagged AND s.detector_name IN {_LATE})")
_add("valid_to_original", _EMPTIED, f"SELECT row_number() OVER (ORDER BY dataset_index) - 1 AS position, dataset_index FROM emptied WHERE {_VALID}")
_add("bt_loss", REWARDS, "SELECT round(avg(greatest(-gap, 0) + ln(1 + exp(-abs(gap)))), 9) AS loss, round(avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM gaps")
_add("reward_eval", REWARDS, "SELECT round(avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, count(*) FILTER (gap > 0) AS correct, count(*) AS total, round(avg(gap), 9) AS avg_reward_gap FROM gaps")
_HASHED = "CAST('0x' || md5({0})[1:8] AS BIGINT)"
_FEATURES = "list_transform(list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])), lambda f: " + _HASHED.format("f") + " % 64)"
_SPREAD = "list_transform(range(64), lambda k: len(list_filter({0}, lambda b: b = k)) / sqrt(greatest(len({0}), 1)))"


def _training(name: str, where: str) -> str:
    """CTEs that end in NAME(t, w, m, v): weights and moments after each step over the pairs ``where`` holds for."""
    return f""", {name}_rows AS (
  SELECT example_id, d, epoch, {_HASHED.format("'1:' || epoch || ':' || example_id")} % (SELECT ceil(count(*) / 100) FROM spread WHERE {where})::BIGINT AS batch
  FROM spread, range(2) AS r(epoch) WHERE {where}
), {name}_steps AS (
  SELECT row_number() OVER (ORDER BY epoch, batch) AS t, list(d) AS ds FROM {name}_rows GROUP BY epoch, batch
), {name}(t, w, m, v) AS (
  SELECT 0::BIGINT, list_transform(range(64), lambda k: 0.0::DOUBLE), list_transform(range(64), lambda k: 0.0::DOUBLE), list_transform(range(64), lambda k: 0.0::DOUBLE)
  UNION ALL
  SELECT t, list_transform(range(1, 65), lambda k: w[k] * (1 - 0.05::DOUBLE * 0.01::DOUBLE) - 0.05::DOUBLE * (m[k] / (1 - pow(0.9::DOUBLE, t))) / (sqrt(v[k] / (1 - pow(0.999::DOUBLE, t))) + 1e-8::DOUBLE)), m, v
  FROM (
    SELECT t, w, list_transform(range(1, 65), lambda k: 0.9::DOUBLE * m[k] + 0.1::DOUBLE * g[k]) AS m, list_transform(range(1, 65), lambda k: 0.999::DOUBLE * v[k] + 0.001::DOUBLE * g[k] * g[k]) AS v
    FROM (
      SELECT t, w, m, v, list_transform(range(1, 65), lambda k: list_sum(list_transform(range(1, len(ds) + 1), lambda i: -ds[i][k] * miss[i])) / len(ds)) AS g
      FROM (SELECT s.t, w, m, v, ds, list_transform(ds, lambda d: 1 / (1 + exp(list_dot_product(w, d)))) AS miss FROM {name} n JOIN {name}_steps s ON s.t = n.t + 1)
    )
  )
)"""


def _tested(name: str) -> str:
    return f"(SELECT list_dot_product(w, d) AS gap FROM spread, (SELECT w FROM {name} ORDER BY t DESC LIMIT 1) WHERE example_id % 5 = 0)"


_SPREADS = f""", features AS (
  SELECT example_id, {_FEATURES.format("cl")} AS c, {_FEATURES.format("rl")} AS r FROM tok
), sides AS (
  SELECT example_id, {_SPREAD.format("c")} AS c, {_SPREAD.format("r")} AS r FROM features
), spread AS (
  SELECT example_id, list_transform(range(1, 65), lambda k: c[k] - r[k]) AS d FROM sides
)"""
_add(
    "reward_train_eval",
    TOKENS + _SPREADS + _training("model", "example_id % 5 <> 0"),
    f"SELECT round(avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, count(*) FILTER (gap > 0) AS correct, count(*) AS total, round(avg(gap), 7) AS avg_reward_gap FROM {_tested('model')}",
)
_add(
    "experiment_compare",
    HISTORY
    + TOKENS.replace(PAIRS, "")
    + _SPREADS
    + _training("clean", f"example_id % 5 <> 0 AND example_id + 1 NOT IN (SELECT s.example_id FROM signals s JOIN latest l ON l.id = s.run_id WHERE s.flagged AND s.detector_name IN {_LATE})")
    + _training("whole", "example_id % 5 <> 0")
    + f", e AS (SELECT * FROM (SELECT avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0 END) AS ca, avg(gap) AS cg FROM {_tested('clean')}), (SELECT avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0 END) AS ua, avg(gap) AS ug FROM {_tested('whole')}))",
    "SELECT round(ca, 7) AS clean_accuracy, round(cg, 7) AS clean_gap, round(ua, 7) AS unfiltered_accuracy, round(ug, 7) AS unfiltered_gap, round(ca - ua, 7) AS accuracy_diff, round(cg - ug, 7) AS gap_diff, CASE WHEN ca - ua > 0 THEN 'clean' ELSE 'unfiltered' END AS winner FROM e",
)
for _name in ("reward_train_eval", "experiment_compare"):
    ORACLES[_name] = ORACLES[_name].replace("WITH", "WITH RECURSIVE", 1)
_add(
    "experiment_winner",
    TOKENS + f", gaps AS (SELECT example_id, {_REWARD('c', 'chosen')} - {_REWARD('r', 'rejected')} AS gap FROM tok), e AS (SELECT avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (example_id % 4 <> 0) AS ca, avg(gap) FILTER (example_id % 4 <> 0) AS cg, avg(CASE WHEN gap > 0 THEN 1.0::DOUBLE ELSE 0 END) AS ua, avg(gap) AS ug FROM gaps)",
    "SELECT round(ca, 9) AS clean_accuracy, round(cg, 9) AS clean_gap, round(ua, 9) AS unfiltered_accuracy, round(ug, 9) AS unfiltered_gap, round(ca - ua, 9) AS accuracy_diff, round(cg - ug, 9) AS gap_diff, CASE WHEN ca - ua > 0 THEN 'clean' ELSE 'unfiltered' END AS winner FROM e",
)
