"""Text and name queries on documents, conversations, events and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import names as N
from tallyspark.functions import text as X
from tallyspark.functions.numbers import measure_text
from tallyspark.operators import joins
from tallyspark.operators.joins import SYNONYMS
from tallyspark.plans.views import table


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- model-style answers: conversations, some fenced, some refused, some cut --------------------


def answers(spark, sf):
    c = table(spark, sf, "conversations")
    k = (F.col("conv_id") * 7 + F.col("turn")) % 6
    t = F.col("text")
    body = (
        F.when(k == 0, F.concat(F.lit("```sql\n"), t, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("I'm sorry, I cannot help with that. "), t))
        .when(k == 3, F.concat(F.lit("Here:\n```\nab\n```\nor\n```json\n"), t, F.lit("\n```"))).otherwise(t)
    )
    cut = F.when(k == 2, F.left(t, F.lit(7))).when(k == 3, F.concat(F.lit("```\n"), F.left(t, F.lit(40)))).when(k == 4, F.lit("zzzzzzz"))
    # Every whole text, and beside it cut and empty-handed answers (a second copy numbered below zero).
    return c.select("conv_id", "turn", body.alias("text")).unionAll(
        c.select("conv_id", (-1 - F.col("turn")).alias("turn"), cut.alias("text")).where("text is not null"))


ANSWERS_SQL = """answers AS (SELECT conv_id, turn, CASE (conv_id * 7 + turn) % 6 WHEN 0 THEN '```sql' || chr(10) || text || chr(10) || '```'
  WHEN 1 THEN 'I''m sorry, I cannot help with that. ' || text 
  WHEN 3 THEN 'Here:' || chr(10) || '```' || chr(10) || 'ab' || chr(10) || '```' || chr(10) || 'or' || chr(10) || '```json' || chr(10) || text || chr(10) || '```'
  ELSE text END AS text FROM conversations
  UNION ALL SELECT conv_id, -1 - turn, CASE (conv_id * 7 + turn) % 6 WHEN 2 THEN left(text, 7) WHEN 3 THEN '```' || chr(10) || left(text, 40) ELSE 'zzzzzzz' END
  FROM conversations WHERE (conv_id * 7 + turn) % 6 IN (2, 3, 4))"""

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
FENCE_SQL = rf"""fenced AS (SELECT *, list_transform(regexp_extract_all({STRIP.format('text')}, {q(X.FENCE_PATTERN)}, 1), lambda b: {STRIP.format('b')}) AS blocks
  FROM answers),
bodies AS (SELECT conv_id, turn, text, CASE WHEN len(blocks) = 0 THEN {STRIP.format('text')}
  ELSE list_filter(blocks, lambda b: length(b) = list_max(list_transform(blocks, lambda x: length(x))))[1] END AS body FROM fenced)"""
REFUSES = "(" + " OR ".join(f"regexp_matches(lower({{0}}), {q(p)})" for p in X.REFUSAL_PATTERNS) + ")"
LETTERS = r"regexp_replace({0}, '[^\p{{L}}]', '', 'g')"
CHARS = "list_filter(string_split({0}, ''), lambda c: c <> '')"
GIBBERISH = (
    r"({0} = '' OR (regexp_full_match({0}, '[A-Za-z0-9]+') AND length({0}) >= 5 AND len(list_distinct(" + CHARS + r")) = 1) OR length(" + LETTERS
    + r") < 6 OR len(list_distinct(" + CHARS.format(LETTERS) + r")) / length(" + LETTERS + r") < 0.35)")


def q_fence_body(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", X.fence_body(F.col("text")).alias("body"))


SQL_FENCE_BODY = f"WITH {ANSWERS_SQL}, {FENCE_SQL} SELECT conv_id, turn, body FROM bodies"


def q_refusal_rows(spark, sf):
    return answers(spark, sf).where(X.is_refusal(F.col("text"))).select("conv_id", "turn")


SQL_REFUSAL = f"WITH {ANSWERS_SQL} SELECT conv_id, turn FROM answers WHERE {REFUSES.format('text')}"


def q_gibberish_rows(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), "text")
    rows = answers(spark, sf).unionByName(docs)
    return rows.where(X.is_gibberish(F.col("text"))).select("conv_id", "turn")


SQL_GIBBERISH = f"""WITH {ANSWERS_SQL.replace('IN (2, 3, 4))', 'IN (2, 3, 4) UNION ALL SELECT doc_id, -1, text FROM documents)')}, {FENCE_SQL}
SELECT conv_id, turn FROM bodies WHERE {GIBBERISH.format('body')}"""


def q_text_verdict(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", X.text_verdict(F.col("text")).alias("reason"))


SQL_TEXT_VERDICT = f"""WITH {ANSWERS_SQL}, {FENCE_SQL} SELECT conv_id, turn, CASE WHEN body = '' THEN 'empty output'
  WHEN {REFUSES.format('body')} THEN 'refusal detected' WHEN {GIBBERISH.format('body')} THEN 'gibberish output' END AS reason FROM bodies"""


def q_noise_filter(spark, sf):
    rows = answers(spark, sf).unionByName(
        table(spark, sf, "part").select(F.col("p_partkey").alias("conv_id"), F.lit(-2).cast("bigint").alias("turn"),
                                        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("show me the "), F.split("p_name", " ")[0]))
                                        .when(F.col("p_size") % 3 == 1, "what is this").otherwise(F.col("p_name")).alias("text")))
    return rows.select("conv_id", "turn", X.noise_verdict(F.col("text")).alias("reason"))


SQL_NOISE = f"""WITH {ANSWERS_SQL.replace('IN (2, 3, 4))', '''IN (2, 3, 4) UNION ALL SELECT p_partkey, -2,
  CASE p_size % 3 WHEN 0 THEN 'show me the ' || string_split(p_name, ' ')[1] WHEN 1 THEN 'what is this' ELSE p_name END FROM part)''')},
t AS (SELECT conv_id, turn, lower({STRIP.format('text')}) AS low FROM answers),
k AS (SELECT *, regexp_extract_all(low, '([a-z]+(?:''[a-z]+)?)', 1) AS tokens FROM t),
r AS (SELECT *, list_filter(tokens, lambda x: length(x) >= 2) AS words FROM k)
SELECT conv_id, turn, CASE WHEN low = '' THEN 'empty' WHEN NOT regexp_matches(low, '[a-z]') THEN 'no letters' WHEN len(tokens) < 2 THEN 'too short'
  WHEN len(words) < 2 THEN 'single letters'
  WHEN len(list_filter(tokens, lambda x: (length(x) >= 4 AND len(list_distinct(string_split(x, ''))) <= 2) OR (length(x) >= 4 AND NOT regexp_matches(x, '[aeiouy]'))
    OR x IN ({', '.join(q(w) for w in X.NOISE_WORDS)}))) > 0 THEN 'noise word'
  WHEN len(list_filter(words, lambda x: x NOT IN ({', '.join(q(w) for w in X.STOP_WORDS)}))) = 0 THEN 'stop words only' END AS reason FROM r"""


def q_json_salvage(spark, sf):
    k = F.col("event_id") % 5
    p = F.col("props")
    text = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("The answer is "), p, F.lit(" as asked.")))
        .when(k == 2, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 3, F.concat(F.lit("{k: "), p)).otherwise("no data")
    )
    found = table(spark, sf, "events").select("event_id", X.json_in_text(text).alias("j"))
    return found.select("event_id", F.col("j.kind").alias("kind"), F.col("j.json").alias("json"))


SQL_JSON_SALVAGE = r"""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'The answer is ' || props || ' as asked.'
  WHEN 2 THEN props WHEN 3 THEN '{k: ' || props ELSE 'no data' END AS body FROM events),
b AS (SELECT *, regexp_extract(body, '(?s)(\{.*\})', 1) AS braces FROM t)
SELECT event_id, CASE WHEN json_valid(body) THEN 'whole' WHEN braces <> '' AND json_valid(braces) THEN 'embedded' ELSE 'none' END AS kind,
  CASE WHEN json_valid(body) THEN body WHEN braces <> '' AND json_valid(braces) THEN braces END AS json FROM b"""


def q_json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


SQL_JSON_FIELD = "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"


def q_list_items(spark, sf):
    d = table(spark, sf, "documents")
    found = d.select("doc_id", X.list_items(F.col("text")).alias("found"))
    return found.select("doc_id", F.size("found").alias("n"), F.array_join("found", " | ").alias("items"))


SQL_LIST_ITEMS = rf"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r\n|\n|\r'),
    lambda s: {STRIP.format(f"regexp_extract({STRIP.format("replace(s, '*', '')")}, {q(X.LIST_MARK_PATTERN)}, 1)")}), lambda s: s <> '') AS items,
  {STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")} AS flat FROM documents),
s AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(flat, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
    lambda x: regexp_replace({STRIP.format('x')}, '\.+$', '')), lambda x: x <> '') AS parts FROM l),
o AS (SELECT doc_id, CASE WHEN len(items) > 0 THEN items WHEN flat = '' THEN [] WHEN len(parts) >= 2 THEN parts ELSE [flat] END AS items FROM s)
SELECT doc_id, len(items) AS n, array_to_string(items, ' | ') AS items FROM o"""

# --- names and numbers -------------------------------------------------------------------------


def part_identifier():
    """large ring / LARGE -> large_ringLARGEId, a column-style name made from each part."""
    return F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_type"), F.lit("Id"))


PART_ID = "replace(p_name, ' ', '_') || p_type || 'Id'"
WORDS_SQL = r"""list_filter(string_split_regex(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'),
  '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"""


def q_identifier_tokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(N.words_expr(part_identifier()), " ").alias("tokens"))


SQL_IDENTIFIER_TOKENS = f"SELECT p_partkey, array_to_string({WORDS_SQL.format(PART_ID)}, ' ') AS tokens FROM part"


def q_singularize(spark, sf):
    w = F.col("word")
    return joins.vocabulary_counts(table(spark, sf, "documents"), "text").select(
        "word", N.singular_expr(w).alias("singular"), N.plural_expr(w).alias("plural"))


VOCABULARY = r"""SELECT word, count(DISTINCT {key}) AS texts FROM (SELECT {key}, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS word FROM {source})
WHERE regexp_full_match(word, '[a-z]+') GROUP BY 1"""
SQL_SINGULARIZE = f"""WITH v AS ({VOCABULARY.format(key='doc_id', source='documents')}) SELECT word,
  CASE WHEN length(word) > 4 AND word LIKE '%ies' THEN left(word, length(word) - 3) || 'y'
       WHEN length(word) > 2 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN left(word, length(word) - 1) ELSE word END AS singular,
  CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN left(word, length(word) - 1) || 'ies'
       WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' ELSE word || 's' END AS plural FROM v"""


def q_safe_names(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", N.safe_name_expr(u).alias("safe"), N.safe_name_expr(F.regexp_replace(u, "^[^0-9]*", "")).alias("safe_digits"),
        N.compact_expr(u).alias("compact"))


SAFE = "trim(lower(regexp_replace({0}, '[^0-9a-zA-Z]+', '_', 'g')), '_')"
SAFE_CASE = f"CASE WHEN {SAFE} = '' THEN 'csv_table' WHEN regexp_matches({SAFE}, '^[0-9]') THEN 't_' || {SAFE} ELSE {SAFE} END"
SQL_SAFE_NAMES = f"""SELECT page_id, {SAFE_CASE.format('url')} AS safe, {SAFE_CASE.format("regexp_replace(url, '^[^0-9]*', '')")} AS safe_digits,
  regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS compact FROM pages"""


def q_format_measure(spark, sf):
    li = table(spark, sf, "lineitem")
    v = F.col("l_extendedprice") * F.when(F.col("l_linenumber") == 1, 100.0).when(F.col("l_linenumber") == 2, 0.01).otherwise(1.0)
    return li.select("l_orderkey", "l_linenumber", measure_text(v + 0.00013).alias("text"))


SQL_FORMAT_MEASURE = """WITH w AS (SELECT l_orderkey, l_linenumber, l_extendedprice * CASE l_linenumber WHEN 1 THEN 100::DOUBLE WHEN 2 THEN 0.01 ELSE 1 END + 0.00013 AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(x) >= 1000000 THEN format('{:.2f}M', x / 1000000) WHEN abs(x) >= 1000 THEN format('{:,.0f}', x)
  WHEN abs(x) >= 100 THEN format('{:,.1f}', x) ELSE format('{:,.2f}', x) END AS text FROM w"""


def q_plain_english(spark, sf):
    jargon = F.array(*[F.lit(w) for w, _ in X.PLAIN_WORDS])
    said = F.concat(F.col("text"), F.lit(" The Median and the "), F.element_at(jargon, (F.col("item_id") % len(X.PLAIN_WORDS) + 1).cast("int")), F.lit(" moved."))
    return table(spark, sf, "benchmark").select("item_id", X.plain_english(said).alias("text"))


def _plain_sql(expr: str) -> str:
    for a, b in X.PLAIN_WORDS:
        expr = f"regexp_replace({expr}, '(?i)\\b{a}\\b', '{b}', 'g')"
    return expr


_JARGON = "[" + ", ".join(q(w) for w, _ in X.PLAIN_WORDS) + "]"
_SAID = f"text || ' The Median and the ' || ({_JARGON})[item_id % {len(X.PLAIN_WORDS)} + 1] || ' moved.'"
SQL_PLAIN_ENGLISH = f"SELECT item_id, {_plain_sql(_SAID)} AS text FROM benchmark"


def q_date_parts(spark, sf):
    d = F.col("ts")
    return table(spark, sf, "events").select("event_id", F.year(d).alias("year"), F.month(d).alias("month"), F.day(d).alias("day"), F.weekday(d).alias("dayofweek"))


SQL_DATE_PARTS = "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS dayofweek FROM events"

# --- words against a vocabulary ----------------------------------------------------------------


def q_term_grounding(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), F.concat_ws(" ", F.col("event_type"), F.lit("of_items by"), F.when(F.col("user_id") % 2 == 0, "clients").otherwise("bosses")).alias("text"))
    docs = table(spark, sf, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return joins.term_grounding(events.unionByName(docs), "doc_id", "text")


_PAIRS = ", ".join(f"({q(t)}, {q(w)})" for t, g in SYNONYMS.items() for w in sorted({t, *g}))
SQL_TERM_GROUNDING = rf"""WITH vocab(term, form) AS (VALUES {_PAIRS}),
src AS (SELECT event_id AS doc_id, event_type || ' of_items by ' || CASE WHEN user_id % 2 = 0 THEN 'clients' ELSE 'bosses' END AS text FROM events
  UNION ALL SELECT -doc_id - 1, text FROM documents),
whole AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM src),
words AS (SELECT DISTINCT doc_id, w AS word FROM whole WHERE w <> '' UNION SELECT doc_id, p FROM (SELECT doc_id, unnest(string_split(w, '_')) AS p FROM whole) WHERE p <> ''),
forms AS (SELECT doc_id, word, word AS form FROM words UNION SELECT doc_id, word, regexp_replace(word, 'ies$', 'y') FROM words WHERE word LIKE '%ies' AND length(word) > 4
  UNION SELECT doc_id, word, regexp_replace(word, 's$', '') FROM words WHERE word LIKE '%s' UNION SELECT doc_id, word, regexp_replace(word, 'ss$', '') FROM words WHERE word LIKE '%ss')
SELECT doc_id, term, count(DISTINCT word) AS score FROM forms JOIN vocab USING (form) GROUP BY 1, 2"""


def q_fuzzy_vocab_join(spark, sf):
    tokens = joins.vocabulary_counts(table(spark, sf, "documents"), "text")
    vocabulary = joins.vocabulary_counts(table(spark, sf, "benchmark"), "text")
    return joins.fuzzy_vocab_join(tokens, vocabulary)


SQL_FUZZY = f"""WITH tokens AS ({VOCABULARY.format(key='doc_id', source='documents')}), v AS ({VOCABULARY.format(key='item_id', source='benchmark')}),
vocab AS (SELECT word AS match FROM v WHERE length(word) >= 2),
opened AS (SELECT word FROM tokens WHERE length(word) >= 2 AND word NOT IN (SELECT match FROM vocab UNION SELECT match || 's' FROM vocab
  UNION SELECT left(match, length(match) - 1) FROM vocab WHERE match LIKE '%s')),
s AS (SELECT word, match, 1 - levenshtein(word, match) / greatest(length(word), length(match)) AS sim FROM opened JOIN vocab ON left(word, 2) = left(match, 2)
  WHERE abs(length(word) - length(match)) <= 0.2 * greatest(length(word), length(match)) + 1e-9)
SELECT word, match, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY sim DESC, match) AS r FROM s WHERE sim >= 0.8 - 1e-9) WHERE r = 1"""

QUERIES = {
    "fence_body": (q_fence_body, SQL_FENCE_BODY),
    "refusal_rows": (q_refusal_rows, SQL_REFUSAL),
    "gibberish_rows": (q_gibberish_rows, SQL_GIBBERISH),
    "text_verdict": (q_text_verdict, SQL_TEXT_VERDICT),
    "noise_filter": (q_noise_filter, SQL_NOISE),
    "json_salvage": (q_json_salvage, SQL_JSON_SALVAGE),
    "json_field": (q_json_field, SQL_JSON_FIELD),
    "list_items": (q_list_items, SQL_LIST_ITEMS),
    "identifier_tokens": (q_identifier_tokens, SQL_IDENTIFIER_TOKENS),
    "singularize": (q_singularize, SQL_SINGULARIZE),
    "safe_names": (q_safe_names, SQL_SAFE_NAMES),
    "format_measure": (q_format_measure, SQL_FORMAT_MEASURE),
    "plain_english": (q_plain_english, SQL_PLAIN_ENGLISH),
    "date_parts": (q_date_parts, SQL_DATE_PARTS),
    "term_grounding": (q_term_grounding, SQL_TERM_GROUNDING),
    "fuzzy_vocab_join": (q_fuzzy_vocab_join, SQL_FUZZY),
}
