"""DuckDB oracle SQL for the registered queries (same column names and types).

DuckDB differs from Spark in ways the SQL works around (SURVEY §5):

* ``levenshtein`` counts bytes: non-ASCII characters are folded to ``chr(1)``
  first; all dictionary keys are ASCII, so distances to keys are unchanged.
* RE2 has no back-references: letter runs are collapsed with a list lambda
  (keep a character unless it equals both predecessors).
* RE2 ``\\s`` lacks ``\\v``: the whitespace class is spelled out.
* no ``str.title``: case forms of the dictionary values come as a VALUES table.
"""

from __future__ import annotations

from wordloom.operators.model import MODEL_TYPE
from wordloom.plans.inputs import BLANK_RESIDUE, BLANK_TEXT, NULL_RESIDUE, SNIPPETS, VIDEO_URL_PREFIX
from wordloom.sources.csv_splits import LABEL_CANDIDATES, PANDAS_NA, TEXT_CANDIDATES
from wordloom.sources.dictionary import CUSTOM_TABLE, DEFAULT_TABLE, read_fixed_table

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()

# RE2 spellings of the word rules.
W = r"\p{L}\p{N}_"
NW = "[^" + W + "]"
WS = (r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
IS_U = r"[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*"
IS_L = r"[^\p{Lu}\p{Lt}]*\p{Ll}[^\p{Lu}\p{Lt}]*"
IS_T = r"[^\p{Lu}\p{Lt}\p{Ll}]*(?:[\p{Lu}\p{Lt}]\p{Ll}*(?:[^\p{Lu}\p{Lt}\p{Ll}]+|$))+"
THRESHOLD = "0.8::DOUBLE"
MAX_DIST = 2
ENCODER_LENGTH = 512


def lit(s: str | None) -> str:
    """SQL literal; control characters as chr() so the text stays one line."""
    if s is None:
        return "NULL"
    parts, buf = [], ""
    for ch in s:
        if ord(ch) < 32:
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def clean(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '^{NW}+|{NW}+$', '', 'g')"


def collapse(expr: str) -> str:
    chars = f"string_split({expr}, '')"
    return (f"array_to_string(list_filter({chars}, lambda x, i: i < 3 OR x <> {chars}[i - 1] "
            f"OR x <> {chars}[i - 2]), '')")


def pattern(expr: str) -> str:
    return (f"CASE WHEN regexp_full_match({expr}, '{IS_U}') THEN 'upper' "
            f"WHEN regexp_full_match({expr}, '{IS_T}') THEN 'title' "
            f"WHEN regexp_full_match({expr}, '{IS_L}') THEN 'lower' ELSE 'mixed' END")


def blank(expr: str) -> str:
    return f"({expr} IS NULL OR {strip(expr)} = '')"


def _entries() -> str:
    rows = []
    for src, path in ((0, DEFAULT_TABLE), (1, CUSTOM_TABLE)):
        for i, (k, v) in enumerate(read_fixed_table(path)):
            rows.append(f"({src}, {i}, {lit(k)}, {lit(v)})")
    return ", ".join(rows)


def _case_forms() -> str:
    values = sorted({v for p in (DEFAULT_TABLE, CUSTOM_TABLE) for _, v in read_fixed_table(p)})
    return ", ".join(f"({lit(v)}, {lit(v.upper())}, {lit(v.title())}, {lit(v.lower())})" for v in values)


def _snippets() -> str:
    return ", ".join(f"({i}, {lit(s)})" for i, s in enumerate(SNIPPETS))


def default_comments() -> str:
    n = len(SNIPPETS)
    return f"""comments AS (
  SELECT d.doc_id AS row_id,
         CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split,
         d.text || ' ' || s.s AS text, d.lang, d.source
  FROM documents d JOIN snip s ON s.i = d.doc_id % {n}
  UNION ALL
  SELECT -1 - doc_id,
         CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END,
         CASE WHEN doc_id % 50 = {BLANK_RESIDUE} THEN {lit(BLANK_TEXT)} END, lang, source
  FROM documents WHERE doc_id % 50 IN ({NULL_RESIDUE}, {BLANK_RESIDUE})),
"""


def base_ctes(comments: str | None = None) -> str:
    comments = comments or default_comments()
    return f"""
dict_entries(src, line, key, value) AS (VALUES {_entries()}),
dict0 AS (
  SELECT key, min(src::BIGINT * 4294967296 + line) AS ord,
         arg_max(value, src::BIGINT * 4294967296 + line) AS value
  FROM dict_entries GROUP BY key),
case_forms(value, value_upper, value_title, value_lower) AS (VALUES {_case_forms()}),
dict AS (SELECT d.ord, d.key, d.value, c.value_upper, c.value_title, c.value_lower
         FROM dict0 d JOIN case_forms c ON c.value = d.value),
snip(i, s) AS (VALUES {_snippets()}),
{comments}toks AS (
  SELECT c.row_id, c.split, CAST(t.pos - 1 AS INTEGER) AS pos, t.word,
         CASE WHEN length(t.word) >= 2 THEN {clean('t.word')} END AS clean
  FROM comments c,
       unnest(regexp_split_to_array({strip('c.text')}, '{WS}+')) WITH ORDINALITY AS t(word, pos)
  WHERE t.word <> ''),
vocab AS (SELECT DISTINCT clean FROM toks WHERE clean <> ''),
exact AS (
  SELECT v.clean, 'exact' AS stage, d.key AS match_key, d.ord, d.value, CAST(NULL AS DOUBLE) AS similarity
  FROM vocab v JOIN dict d ON v.clean = d.key),
rest AS (SELECT v.clean FROM vocab v ANTI JOIN dict d ON v.clean = d.key),
cand AS (
  SELECT r.clean, d.key AS match_key, d.ord, d.value,
         CAST(levenshtein(regexp_replace(r.clean, '[^\\x00-\\x7f]', chr(1), 'g'), d.key) AS INTEGER) AS distance,
         length(r.clean) AS lc, length(d.key) AS lk
  FROM rest r JOIN dict d ON abs(length(r.clean) - length(d.key)) <= {MAX_DIST}),
gated AS (
  SELECT *, CASE WHEN lc = 0 OR lk = 0 THEN 0.0::DOUBLE
                 ELSE 1.0::DOUBLE - distance::DOUBLE / greatest(lc, lk)::DOUBLE END AS similarity
  FROM cand WHERE distance <= {MAX_DIST}),
passing AS (SELECT * FROM gated WHERE similarity >= {THRESHOLD} AND similarity > 0.0::DOUBLE),
fuzzy AS (
  SELECT clean, 'fuzzy' AS stage, match_key, ord, value, similarity
  FROM (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY similarity DESC, ord ASC) AS rn FROM passing)
  WHERE rn = 1),
rest2 AS (SELECT r.clean FROM rest r ANTI JOIN fuzzy f ON r.clean = f.clean),
collapsed AS (SELECT clean, {collapse('clean')} AS collapsed FROM rest2 WHERE length(clean) >= 3),
stretch AS (
  SELECT c.clean, 'stretch' AS stage, d.key AS match_key, d.ord, d.value, CAST(NULL AS DOUBLE) AS similarity
  FROM collapsed c JOIN dict d ON c.collapsed = d.key WHERE c.collapsed <> c.clean),
word_map AS (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy UNION ALL SELECT * FROM stretch),
ann0 AS (
  SELECT t.row_id, t.split, t.pos, t.word, t.clean, m.stage AS hit, m.match_key, m.value,
         d.value_upper, d.value_title, d.value_lower, {pattern('t.word')} AS pattern,
         CASE WHEN t.clean IS NULL THEN 'short' WHEN t.clean = '' THEN 'skipped'
              ELSE coalesce(m.stage, 'none') END AS stage
  FROM toks t LEFT JOIN word_map m ON t.clean = m.clean LEFT JOIN dict d ON d.key = m.match_key),
ann AS (
  SELECT *, CASE WHEN hit IS NULL THEN word
                 ELSE regexp_extract(word, '^{NW}*', 0)
                      || CASE pattern WHEN 'upper' THEN value_upper WHEN 'title' THEN value_title
                                      WHEN 'lower' THEN (CASE WHEN hit = 'stretch' THEN value ELSE value_lower END)
                                      ELSE value END
                      || regexp_extract(word, '{NW}*$', 0) END AS out_word
  FROM ann0),
regrouped AS (SELECT row_id, string_agg(out_word, ' ' ORDER BY pos) AS text FROM ann GROUP BY row_id),
processed AS (
  SELECT c.row_id, c.split, r.text, c.lang, c.source, c.text AS text_original
  FROM comments c JOIN regrouped r ON r.row_id = c.row_id
  WHERE NOT {blank('r.text')}),
stats AS (
  SELECT split,
         CAST(count(*) FILTER (WHERE stage = 'exact') AS BIGINT) AS exact_matches,
         CAST(count(*) FILTER (WHERE stage IN ('fuzzy', 'stretch')) AS BIGINT) AS fuzzy_matches,
         CAST(count(*) FILTER (WHERE stage = 'stretch') AS BIGINT) AS stretch_matches,
         CAST(count(*) FILTER (WHERE stage = 'none') AS BIGINT) AS no_matches,
         CAST(count(*) FILTER (WHERE stage IN ('exact', 'fuzzy', 'stretch', 'none')) AS BIGINT) AS total_words
  FROM ann GROUP BY split),
labels_in AS (
  SELECT c.row_id, c.split, c.text, CAST(l.quality AS VARCHAR) AS label,
         CASE WHEN l.toxic = 1 THEN '0' ELSE '1' END AS pred
  FROM comments c JOIN labels l ON l.doc_id = c.row_id),
mapping AS (
  SELECT label, CAST(row_number() OVER (ORDER BY first_row) - 1 AS INTEGER) AS idx
  FROM (SELECT label, min(row_id) AS first_row FROM labels_in WHERE split = 'train' AND label IS NOT NULL
        GROUP BY label)),
scored AS (
  SELECT x.*, m1.idx AS label_idx, m2.idx AS pred_idx
  FROM labels_in x LEFT JOIN mapping m1 ON m1.label = x.label LEFT JOIN mapping m2 ON m2.label = x.pred),
train_toks AS (
  SELECT c.row_id, CAST(t.pos - 1 AS INTEGER) AS pos, {clean('t.tok')} AS word
  FROM comments c,
       unnest(regexp_split_to_array({strip('lower(c.text)')}, '{WS}+')) WITH ORDINALITY AS t(tok, pos)
  WHERE c.split = 'train' AND c.text IS NOT NULL AND t.tok <> ''),
word_freq AS (
  SELECT word, CAST(count(*) AS BIGINT) AS freq, min(row_id * 1000000000 + pos) AS first_seen
  FROM train_toks WHERE length(word) >= 2 GROUP BY word),
freq_oov AS (SELECT f.* FROM word_freq f ANTI JOIN dict d ON f.word = d.key WHERE f.freq >= 3)
"""


def with_base(select: str, comments: str | None = None) -> str:
    return "WITH " + base_ctes(comments).strip() + "\n" + select.strip()


SELECTS: dict[str, str] = {
    "dictionary_merged": """
        SELECT d.ord, d.key, d.value, coalesce(h.n_tokens, 0) AS n_tokens
        FROM dict0 d LEFT JOIN (SELECT match_key, CAST(count(*) AS BIGINT) AS n_tokens FROM ann
                                WHERE hit IS NOT NULL GROUP BY match_key) h ON h.match_key = d.key""",
    "tokens": "SELECT row_id, pos, word FROM toks",
    "clean_words": f"SELECT row_id, pos, word, {clean('word')} AS clean FROM toks",
    "case_pattern": f"SELECT word, {pattern('word')} AS pattern FROM (SELECT DISTINCT word FROM toks)",
    "destretched": f"SELECT clean, {collapse('clean')} AS collapsed FROM vocab WHERE {collapse('clean')} <> clean",
    "word_similarity": "SELECT clean, match_key, distance, similarity FROM passing",
    "exact_matches": ("SELECT clean, match_key, value, CAST(count(*) AS BIGINT) AS n_tokens FROM ann "
                      "WHERE stage = 'exact' GROUP BY clean, match_key, value"),
    "fuzzy_matches": "SELECT clean, match_key, value, similarity FROM fuzzy",
    "stretch_matches": "SELECT clean, match_key, value FROM stretch",
    "oov_words": "SELECT clean FROM rest",
    "word_map": "SELECT clean, stage, match_key, value, similarity FROM word_map",
    "normalized_tokens": "SELECT row_id, pos, word, stage, out_word FROM ann",
    "normalized_text": ("SELECT c.row_id, coalesce(p.text, '') AS text FROM comments c "
                        "LEFT JOIN processed p ON p.row_id = c.row_id"),
    "preprocess_documents": "SELECT row_id, split, text, lang, source, text_original FROM processed",
    "blank_rows_removed": """
        SELECT b.split, b.rows_in, coalesce(a.rows_out, 0) AS rows_out, b.rows_in - coalesce(a.rows_out, 0) AS removed
        FROM (SELECT split, CAST(count(*) AS BIGINT) AS rows_in FROM comments GROUP BY split) b
        LEFT JOIN (SELECT split, CAST(count(*) AS BIGINT) AS rows_out FROM processed GROUP BY split) a
          ON a.split = b.split""",
    "changed_rows": """
        SELECT split,
               CAST(count(*) FILTER (WHERE text_original IS DISTINCT FROM text) AS BIGINT) AS changed,
               CAST(count(*) FILTER (WHERE text_original IS NOT DISTINCT FROM text) AS BIGINT) AS unchanged
        FROM processed GROUP BY split""",
    "normalization_stats": "SELECT * FROM stats",
    "normalization_rates": """
        SELECT split, total_words,
               CASE WHEN total_words > 0 THEN exact_matches::DOUBLE / total_words::DOUBLE * 100.0::DOUBLE END AS exact_pct,
               CASE WHEN total_words > 0 THEN fuzzy_matches::DOUBLE / total_words::DOUBLE * 100.0::DOUBLE END AS fuzzy_pct,
               CASE WHEN total_words > 0 THEN no_matches::DOUBLE / total_words::DOUBLE * 100.0::DOUBLE END AS none_pct,
               CASE WHEN total_words > 0 THEN (exact_matches + fuzzy_matches)::DOUBLE / total_words::DOUBLE
                    * 100.0::DOUBLE END AS normalized_pct
        FROM stats""",
    "oov_distinct_count": "SELECT CAST(count(*) AS BIGINT) AS fuzzy_cache_size FROM rest",
    "word_frequency": "SELECT word, freq FROM word_freq",
    "frequent_oov": "SELECT word, freq FROM freq_oov",
    "oov_first_seen_20": """
        SELECT word, freq, CAST(row_number() OVER (ORDER BY freq DESC, first_seen ASC) AS INTEGER) AS rank
        FROM (SELECT * FROM freq_oov ORDER BY first_seen LIMIT 20)""",
    "oov_topk": """
        SELECT word, freq, CAST(row_number() OVER (ORDER BY freq DESC, word ASC) AS INTEGER) AS rank
        FROM (SELECT * FROM freq_oov ORDER BY freq DESC, word ASC LIMIT 20)""",
    "label_distribution": ("SELECT label, CAST(count(*) AS BIGINT) AS n FROM labels_in "
                           "WHERE split = 'train' AND label IS NOT NULL GROUP BY label"),
    "label_mapping": "SELECT label, idx FROM mapping",
    "label_encode": "SELECT row_id, split, label, label_idx FROM scored",
    "accuracy": """
        SELECT split, CAST(count(*) AS BIGINT) AS n,
               avg(CASE WHEN label_idx = pred_idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
        FROM scored WHERE label_idx IS NOT NULL GROUP BY split""",
    "classification_report": """
        , t AS (SELECT * FROM scored WHERE split = 'test' AND label_idx IS NOT NULL),
        per AS (
          SELECT m.label, m.idx,
                 (SELECT count(*) FROM t WHERE t.label_idx = m.idx) AS support,
                 (SELECT count(*) FROM t WHERE t.label_idx = m.idx AND t.pred_idx = m.idx) AS tp,
                 (SELECT count(*) FROM t WHERE t.pred_idx = m.idx) AS predicted
          FROM mapping m),
        per2 AS (
          SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted::DOUBLE ELSE 0.0::DOUBLE END AS precision,
                    CASE WHEN support > 0 THEN tp::DOUBLE / support::DOUBLE ELSE 0.0::DOUBLE END AS recall
          FROM per),
        per3 AS (
          SELECT *, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall)
                         ELSE 0.0::DOUBLE END AS f1_score
          FROM per2),
        tot AS (
          SELECT sum(support) AS s, sum(tp) AS tp, count(*) AS k, sum(precision) AS sp, sum(recall) AS sr,
                 sum(f1_score) AS sf, sum(precision * support) AS wp, sum(recall * support) AS wr,
                 sum(f1_score * support) AS wf
          FROM per3)
        SELECT label AS class, precision, recall, f1_score, CAST(support AS BIGINT) AS support FROM per3
        UNION ALL
        SELECT 'accuracy', NULL, NULL, CASE WHEN s > 0 THEN tp::DOUBLE / s::DOUBLE ELSE 0.0::DOUBLE END,
               CAST(s AS BIGINT) FROM tot
        UNION ALL
        SELECT 'macro avg', sp / k, sr / k, sf / k, CAST(s AS BIGINT) FROM tot
        UNION ALL
        SELECT 'weighted avg', CASE WHEN s > 0 THEN wp / s::DOUBLE ELSE 0.0::DOUBLE END,
               CASE WHEN s > 0 THEN wr / s::DOUBLE ELSE 0.0::DOUBLE END,
               CASE WHEN s > 0 THEN wf / s::DOUBLE ELSE 0.0::DOUBLE END, CAST(s AS BIGINT) FROM tot""",
    "confusion_matrix": """
        SELECT m.label AS true_label, m.idx AS true_idx,
               CAST(count(s.row_id) FILTER (WHERE s.pred_idx = 0) AS BIGINT) AS pred_0,
               CAST(count(s.row_id) FILTER (WHERE s.pred_idx = 1) AS BIGINT) AS pred_1
        FROM mapping m LEFT JOIN scored s ON s.label_idx = m.idx AND s.split = 'test'
        GROUP BY m.label, m.idx""",
}


def na(expr: str) -> str:
    """pandas default NA strings -> NULL."""
    items = ", ".join(lit(v) for v in PANDAS_NA)
    return f"CASE WHEN {expr} IN ({items}) THEN NULL ELSE {expr} END"


def video_comments() -> str:
    return f"""req AS (SELECT DISTINCT {lit(VIDEO_URL_PREFIX)} || CAST(conv_id AS VARCHAR) AS url FROM conversations),
reqv AS (SELECT url, regexp_extract(url, '[?&]v=([^&#]*)', 1) AS video_id FROM req),
comments AS (
  SELECT c.conv_id * 1000000 + c.turn AS row_id, 'all' AS split, c.text, r.url, r.video_id, c.turn, c.role,
         CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS source
  FROM conversations c JOIN reqv r ON r.video_id = CAST(c.conv_id AS VARCHAR)),
"""


SELECTS.update({
    "scan_csv_splits": f"SELECT row_id, split, {na('text')} AS text, {na('label')} AS label FROM labels_in",
    "split_profile": """
        SELECT split, CAST(count(*) AS BIGINT) AS n_rows, 4 AS n_columns, 'row_id,text,label,split' AS column_names,
               """ + ", ".join(f"max({c}) FILTER (WHERE rk = {i}) AS {c}_{i}" for i in (1, 2) for c in ("row_id", "text", "label")) + """
        FROM (SELECT split, row_id, text, label, row_number() OVER (PARTITION BY split ORDER BY row_id) AS rk FROM labels_in)
        GROUP BY split""",
    "processed_roundtrip": (f"SELECT row_id, split, {na('text')} AS text, {na('lang')} AS lang, "
                            f"{na('source')} AS source, {na('text_original')} AS text_original FROM processed"),
    "artifact_record": f"""
        SELECT {lit(MODEL_TYPE)} AS model_type, {THRESHOLD} AS levenshtein_threshold, {MAX_DIST} AS fuzzy_threshold,
               exact_matches, fuzzy_matches, no_matches, total_words,
               (SELECT CAST(count(*) AS BIGINT) FROM rest) AS fuzzy_cache_size,
               (SELECT string_agg(key || '=' || value, ';' ORDER BY ord) FROM dict0) AS dictionary_pairs,
               (SELECT string_agg(label || '=' || idx, ';' ORDER BY idx) FROM mapping) AS label_pairs
        FROM stats WHERE split = 'test'""",
    "sample_rows": """
        SELECT p.row_id, p.text_original AS original, p.text AS processed, l.label,
               (p.text_original IS DISTINCT FROM p.text) AS changed
        FROM processed p JOIN labels_in l ON l.row_id = p.row_id
        WHERE p.split = 'train' ORDER BY p.row_id LIMIT 5""",
    "fuzzy_examples": """
        , fz AS (
          SELECT clean, min(CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END * 1000000000000000
                            + row_id * 1000000 + pos) AS first_seen
          FROM ann WHERE stage = 'fuzzy' GROUP BY clean),
        fz2 AS (SELECT f.clean, f.first_seen, w.value, w.similarity FROM fz f JOIN fuzzy w ON w.clean = f.clean)
        SELECT CAST(row_number() OVER (ORDER BY first_seen) AS INTEGER) AS rank, clean, value, similarity,
               (SELECT CAST(count(*) AS BIGINT) FROM fz) AS n_fuzzy_words
        FROM (SELECT * FROM fz2 ORDER BY first_seen LIMIT 10)""",
})

_TEST_ACCURACY = ("(SELECT avg(CASE WHEN label_idx = pred_idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM scored "
                  "WHERE split = 'test' AND label_idx IS NOT NULL)")


def _samples(split: str) -> str:
    return f"(SELECT CAST(count(*) AS BIGINT) FROM processed p JOIN labels l ON l.doc_id = p.row_id WHERE p.split = '{split}')"


SELECTS.update({
    "final_summary": f"""
        SELECT {_TEST_ACCURACY} AS test_accuracy, {_samples('train')} AS train_samples, {_samples('val')} AS val_samples,
               {_samples('test')} AS test_samples, total_words, exact_matches, fuzzy_matches, no_matches,
               exact_matches + fuzzy_matches AS words_normalized,
               CASE WHEN total_words > 0 THEN (exact_matches + fuzzy_matches)::DOUBLE / total_words::DOUBLE * 100.0::DOUBLE
                    ELSE 0.0::DOUBLE END AS normalization_rate
        FROM stats WHERE split = 'test'""",
    "report_record": f"""
        SELECT {_TEST_ACCURACY} AS test_accuracy, {lit(MODEL_TYPE)} AS model_type, {ENCODER_LENGTH} AS max_sequence_length,
               exact_matches, fuzzy_matches, no_matches, total_words,
               {_samples('train')} AS train, {_samples('val')} AS val, {_samples('test')} AS test,
               {THRESHOLD} AS threshold, {MAX_DIST} AS max_edit_distance,
               (SELECT CAST(count(*) AS BIGINT) FROM rest) AS cache_size
        FROM stats WHERE split = 'test'""",
    "model_roundtrip": """
        SELECT x.row_id, x.label, true AS same FROM labels_in x JOIN processed p ON p.row_id = x.row_id WHERE x.split = 'test'""",
    "stream_scored": "SELECT row_id, text_original AS original_text, text AS processed_text, true AS same FROM processed",
})

RESOLVE_SQL = f"""
WITH cols AS (
  SELECT table_name AS tbl, column_name AS col, ordinal_position AS pos, data_type
  FROM information_schema.columns
  WHERE table_name IN ({", ".join(lit(t) for t in DRIVER_TABLES)})),
cand_t(col, r) AS (VALUES {", ".join(f"({lit(c)}, {i})" for i, c in enumerate(TEXT_CANDIDATES))}),
cand_l(col, r) AS (VALUES {", ".join(f"({lit(c)}, {i})" for i, c in enumerate(LABEL_CANDIDATES))}),
t1 AS (SELECT c.tbl, arg_min(c.col, t.r) AS text_col FROM cols c JOIN cand_t t ON t.col = c.col GROUP BY c.tbl),
l1 AS (SELECT c.tbl, arg_min(c.col, l.r) AS label_col FROM cols c JOIN cand_l l ON l.col = c.col GROUP BY c.tbl),
fs AS (SELECT tbl, arg_min(col, pos) AS s FROM cols WHERE data_type = 'VARCHAR' GROUP BY tbl),
fn AS (SELECT tbl, arg_min(col, pos) AS n FROM cols
       WHERE data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT') GROUP BY tbl),
res AS (
  SELECT tb.tbl AS table_name,
         CASE WHEN t1.text_col IS NOT NULL AND l1.label_col IS NOT NULL THEN t1.text_col ELSE fs.s END AS text_col,
         CASE WHEN t1.text_col IS NOT NULL AND l1.label_col IS NOT NULL THEN l1.label_col ELSE fn.n END AS label_col,
         (t1.text_col IS NOT NULL AND l1.label_col IS NOT NULL) AS by_name
  FROM (SELECT DISTINCT tbl FROM cols) tb
  LEFT JOIN t1 ON t1.tbl = tb.tbl LEFT JOIN l1 ON l1.tbl = tb.tbl
  LEFT JOIN fs ON fs.tbl = tb.tbl LEFT JOIN fn ON fn.tbl = tb.tbl)
SELECT r.table_name, r.text_col, r.label_col, n.n_rows FROM res r
JOIN (__COUNTS__) n ON n.table_name = r.table_name
WHERE r.by_name OR (r.text_col IS NOT NULL AND r.label_col IS NOT NULL)
""".replace("__COUNTS__", " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for t in DRIVER_TABLES))

VIDEO_SQL_SELECT = """
SELECT c.url, c.video_id, c.turn, c.role, r.text, c.text AS text_original
FROM comments c JOIN regrouped r ON r.row_id = c.row_id
WHERE NOT """


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sel in SELECTS.items():
        sel = sel.strip()
        if sel.startswith(","):
            # the select adds CTEs of its own after the shared ones
            out[name] = "WITH " + base_ctes().strip() + "\n" + sel
        else:
            out[name] = with_base(sel)
    out["resolve_columns"] = RESOLVE_SQL
    out["comments_for_video"] = with_base(VIDEO_SQL_SELECT + blank("r.text"), video_comments())
    return out


ENCODED_SQL = """
, enc_tok AS (
  SELECT p.row_id, p.split, CAST(t.pos - 1 AS INTEGER) AS pos, t.tok
  FROM processed p, unnest(regexp_split_to_array({strip}, '{ws}+')) WITH ORDINALITY AS t(tok, pos)
  WHERE t.tok <> ''),
vocab_top AS (
  SELECT tok, count(*) AS n FROM enc_tok WHERE split = 'train' GROUP BY tok),
vocab_ids AS (SELECT tok, CAST(row_number() OVER (ORDER BY n DESC, tok ASC) - 1 + 4 AS INTEGER) AS id FROM vocab_top),
body AS (
  SELECT e.row_id, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ',' ORDER BY e.pos) AS ids, count(*) AS n
  FROM enc_tok e LEFT JOIN vocab_ids v ON v.tok = e.tok WHERE e.pos < {keep} GROUP BY e.row_id)
SELECT p.row_id, p.split, CAST(coalesce(b.n, 0) + 2 AS INTEGER) AS n_real,
       '0' || CASE WHEN b.ids IS NULL THEN '' ELSE ',' || b.ids END || ',2'
           || repeat(',1', CAST({keep} - coalesce(b.n, 0) AS INTEGER)) AS input_ids
FROM processed p LEFT JOIN body b ON b.row_id = p.row_id
"""


def _encoded_sql(final_select: str | None = None) -> str:
    sel = ENCODED_SQL.format(strip=strip("lower(p.text)"), ws=WS, keep=ENCODER_LENGTH - 2)
    if final_select is not None:  # keep the CTEs, replace the final SELECT
        sel = sel[:sel.index("\nSELECT p.row_id")] + "\n" + final_select
    return "WITH " + base_ctes().strip() + "\n" + sel.strip()


_base_oracle_sql = oracle_sql


def oracle_sql() -> dict[str, str]:  # noqa: F811
    out = _base_oracle_sql()
    out["encoded_padded"] = _encoded_sql()
    out["encoder_vocabulary"] = _encoded_sql("SELECT tok, id FROM vocab_ids")
    # the stream must give the batch results
    out["stream_normalized"] = out["preprocess_documents"]
    out["stream_stats"] = out["normalization_stats"]
    return out
