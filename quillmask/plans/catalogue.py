"""Registered queries of the engine and the SQL that yields the same rows.

Each query reads whole tables; columns that are computed carry the same names on both sides. Types
that the documents lack are looked for in texts made from the customers, by expressions that both sides share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.functions import patterns as P
from quillmask.functions import validators as V
from quillmask.functions.entities import Policy, settings
from quillmask.functions.local import CustomDetector, Span
from quillmask.operators import evaluate, tiers
from quillmask.operators.engine import Masker, register_sql
from quillmask.operators.clusters import resolved_rows
from quillmask.operators.scoring import exploded
from quillmask.session import shared_folder, ship_package
from quillmask.sources import files, ranges
from quillmask.streaming import chunks, halo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- scans: what a shape finds, before scoring --------------------------------------------------

EMAIL = next(s.regex for s in P.SHAPES if s.kind == "email")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_ASSIGNED = next(s.regex for s in P.SHAPES if s.kind == "api_key")
_IPV4_SQL = rf"list_filter(list_transform(regexp_extract_all(text, '[0-9.]+'), lambda r: regexp_extract(r, '^((?:{_OCTET}\.){{3}}{_OCTET})(?:\.(?:\..*)?)?$', 1)), lambda r: r <> '')"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN_SQL = (
    "list_sum(list_transform(range(len(d)), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN "
    "(2 * CAST(d[i + 1] AS INT)) // 10 + (2 * CAST(d[i + 1] AS INT)) % 10 ELSE CAST(d[i + 1] AS INT) END)) % 10 = 0"
)
_PHONE_OK = rf"(len({_DIGITS}) BETWEEN 7 AND 15 AND NOT regexp_matches(m, '^(19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}$') AND NOT regexp_matches(m, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$'))"
#: Neighbours are consumed here, so a space between two runs that are too long to be one is doubled.
_CARD_SQL = "regexp_extract_all(regexp_replace(text, '([0-9]{13,}) ([0-9]{13,})', '\\1  \\2', 'g'), '(?:^|[^0-9-])((?:[0-9][ -]?){12,18}[0-9])(?:[^0-9-]|$)', 1)"


#: Words, as Python and the plans know them: letters and digits of any script.
_W = r"\p{L}\p{N}_"
_D = r"\p{Nd}"


def _spans_sql(table: str, columns: str, run: str, shape: str, least: str = "") -> str:
    r"""SQL of a row a match: the columns, s (characters before it) and m.

    RE2 has no look at neighbours without taking them, so that of two matches with one character between
    them the second would be lost. ``run`` finds stretches that hold all matches; in each of them ``shape``
    is tried at every place, as ``^`` the neighbour before, the match as a group, the neighbour behind; the
    first that does not begin in the one before it is taken. Line feeds stand for the text's edges.
    """
    at = "len(array_to_string(gaps[1:i], '')) + len(array_to_string(runs[1:i - 1], ''))"
    pieces = f"list_transform(range(1, len(runs) + 1), lambda i: {{'at': {at}, 'piece': right(gaps[i], 1) || runs[i] || left(gaps[i + 1], 1)}})"
    found = f"list_filter(list_transform(range(1, len(p.piece)), lambda j: {{'s': p.at + j - 2, 'm': regexp_extract(p.piece[j:{least}], '{shape}', 1)}}), lambda x: x.m <> '')"
    none = "CAST([] AS STRUCT(s BIGINT, m VARCHAR)[])"
    taken = f"list_reduce(list_concat([{none}], list_transform({found}, lambda x: [x])), lambda a, x: CASE WHEN len(a) = 0 OR a[-1].s + len(a[-1].m) <= x[1].s THEN list_concat(a, x) ELSE a END)"
    return (
        f"(SELECT {columns}, h.s AS s, h.m AS m FROM (SELECT {columns}, unnest({taken}) AS h FROM (SELECT {columns}, unnest({pieces}) AS p FROM "
        f"(SELECT {columns}, string_split_regex(chr(10) || text || chr(10), '{run}') AS gaps, regexp_extract_all(chr(10) || text || chr(10), '{run}') AS runs FROM {table}))))"
    )


def _cards_sql(table: str, columns: str) -> str:
    found = _spans_sql(table, columns, rf"[{_D} -]{{13,}}", rf"^[^{_D}-]((?:{_D}[ -]?){{12,18}}{_D})[^{_D}-]", "j + 40")
    digits = f"string_split(regexp_replace(translate(m, '{V.ODD_DIGITS}', '{V.PLAIN_DIGITS}'), '[^0-9]', '', 'g'), '')"
    return f"(SELECT {columns}, s, m FROM (SELECT *, {digits} AS d FROM {found}) WHERE len(d) BETWEEN 13 AND 19 AND {_LUHN_SQL})"


def _emails_sql(table: str, columns: str) -> str:
    local, domain = "[A-Za-z0-9._%+-]", r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    # A match begins and ends where words do.
    shape = rf"^(?:[^{_W}]([A-Za-z0-9_]{local}*{domain})|[{_W}]([.%+-]{local}*{domain}))[^{_W}]"
    both = _spans_sql(table, columns, f"{local}+@[A-Za-z0-9._%+@-]+", shape)
    one = f"regexp_extract(p.piece[j:], '{shape}', 1)"
    return both.replace(one, f"{one} || {one[:-2]}2)")


def _ipv4_sql(table: str, columns: str) -> str:
    octet = f"(?:25[0-5]|2[0-4]{_D}|1{_D}{_D}|[1-9]?{_D})"
    return _spans_sql(table, columns, rf"[{_D}.]{{7,}}", rf"^[^{_D}.]((?:{octet}\.){{3}}{octet})(?:[^{_D}.]|\.[^{_D}])", "j + 18")


def _phones_sql(run: str, shape: str) -> str:
    """doc_id, match and how often, of phone numbers of this shape."""
    shape, digits = shape.replace(r"\d", _D).replace(r"\w", _W), f"regexp_replace(m, '[^{_D}]', '', 'g')"
    shaped = f"regexp_matches(m, '^(19|20){_D}{{2}}-{_D}{{2}}-{_D}{{2}}$') OR regexp_matches(m, '^{_D}{{3}}-{_D}{{2}}-{_D}{{4}}$')"
    found = _spans_sql("documents", "doc_id", run, rf"^{shape}(?:[^{_W}.-]|\.[^{_D}])", "j + 48")
    return f"SELECT doc_id, m AS match, count(*) AS n FROM {found} WHERE len({digits}) BETWEEN 7 AND 15 AND NOT ({shaped}) GROUP BY ALL"


#: Words near a span, or in it, that lower its confidence.
_PLACEHOLDERS = "example|sample|dummy|test|fake|placeholder|lorem|xxx-xx"


def _found(frame: DataFrame, key: str, spans: Column) -> DataFrame:
    """key, match and how often."""
    return exploded(frame.select(key, spans.alias("c")), [key], "c", "s").groupBy(key, F.col("s.text").alias("match")).agg(F.count("*").alias("n"))


def _scan_sql(table: str, key: str, column: str, matches: str, where: str = "true") -> str:
    return f"WITH m AS (SELECT {key}, unnest({matches.replace('text', column) if column != 'text' else matches}) AS m FROM {table}) SELECT {key}, m AS match, count(*) AS n FROM m WHERE {where} GROUP BY ALL"


def _shape(kind: str, nth: int = 0) -> tuple[int, P.Shape]:
    return [(i, s) for i, s in enumerate(P.SHAPES) if s.kind == kind][nth]


def _scan(kind: str, nth: int = 0, table: str = "documents", key: str = "doc_id", column: str = "text"):
    i, shape = _shape(kind, nth)
    return lambda spark, sf_dir: _found(_read(spark, sf_dir, table, key, column), key, tiers.shape_spans(column, shape, i))


QUERIES["scan_email"] = _scan("email")
ORACLE["scan_email"] = _scan_sql("documents", "doc_id", "text", f"regexp_extract_all(text, '{EMAIL}')")
QUERIES["scan_api_key"] = _scan("api_key")
ORACLE["scan_api_key"] = _scan_sql("documents", "doc_id", "text", f"regexp_extract_all(text, {_quoted(_ASSIGNED)}, 1)")
QUERIES["scan_assigned_tokens_pages"] = _scan("api_key", table="pages", key="page_id", column="html")
ORACLE["scan_assigned_tokens_pages"] = _scan_sql("pages", "page_id", "html", f"regexp_extract_all(text, {_quoted(_ASSIGNED)}, 1)")
QUERIES["scan_email_pages"] = _scan("email", table="pages", key="page_id", column="html")
ORACLE["scan_email_pages"] = _scan_sql("pages", "page_id", "html", f"regexp_extract_all(text, '{EMAIL}')")
QUERIES["scan_ipv4"] = _scan("ipv4")
ORACLE["scan_ipv4"] = _scan_sql("documents", "doc_id", "text", _IPV4_SQL)
QUERIES["scan_cards_luhn"] = _scan("credit_card")
ORACLE["scan_cards_luhn"] = f"SELECT doc_id, m AS match, count(*) AS n FROM {_cards_sql('documents', 'doc_id')} GROUP BY ALL"
QUERIES["scan_phone_structured"] = _scan("phone")
ORACLE["scan_phone_structured"] = _phones_sql(
    rf"[+(){_D} .-]{{7,}}", r"[^\w.-]((?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{1,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,4})"
)
QUERIES["scan_phone_bare"] = _scan("phone", 1)
ORACLE["scan_phone_bare"] = _phones_sql(rf"[{_D} .-]{{8,}}", r"[^\w.+(-](\d{2,4}(?:[ .-]\d{2,4}){2,4})")


@query("scan_bare9", "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9-]+')) AS m FROM documents) SELECT doc_id, m AS match, count(*) AS n FROM m WHERE regexp_full_match(m, '[0-9]{9}') GROUP BY ALL")
def scan_bare9(spark, sf_dir):
    documents = _read(spark, sf_dir, "documents", "doc_id", "text")
    return _found(documents, "doc_id", tiers.matches("text", P.java(P.BARE_SSN)))


@query(
    "scan_entropy",
    "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{20,}')) AS m FROM documents), "
    "e AS (SELECT *, round(list_entropy(string_split(m, '')), 9) AS h FROM m) SELECT doc_id, m AS match, count(*) AS n FROM e "
    "WHERE len(m) >= 24 AND NOT regexp_full_match(m, '[A-Za-z]+') AND CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN len(m) >= 32 AND h >= 3 ELSE h >= 4 END GROUP BY ALL",
)
def scan_entropy(spark, sf_dir):
    return _found(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", tiers.entropy_spans("text"))


# ---- types that the documents lack: texts made from customers, by expressions that Spark and SQL share ----

_H = "md5(cast(c_custkey AS string))"


def _digits_sql(number: str, size: int) -> str:
    return f"lpad(cast({number} AS string), {size}, '0')"


#: A credential of each kind, put together from pieces, and one that is just not; h: a hash in hex digits.
_MADE = {
    "private_key": ("concat('-----BEGIN RSA ', 'PRIVATE KEY-----', chr(10), h, chr(10), '-----END RSA ', 'PRIVATE KEY-----')", "concat('-----BEGIN PUBLIC KEY-----', chr(10), h, '-----END PUBLIC KEY-----')"),
    "jwt": ("concat('ey', 'J', h, '.', h, '.', h)", "concat('ey', 'J', h, '.', substr(h, 1, 5), '.', h)"),
    "aws_key": ("concat('AK', 'IA', substr(upper(h), 1, 16))", "concat('AK', 'IA', substr(upper(h), 1, 17))"),
    "github_token": ("concat('gh', 'p_', h, substr(h, 1, 4))", "concat('gh', 'x_', h, h)"),
    "slack_token": ("concat('xo', 'xb-', substr(h, 1, 12), '-', substr(h, 5, 12))", "concat('xo', 'xz-', h)"),
    "slack_webhook": ("concat('https://hooks.slack', '.com/services/T', substr(upper(h), 1, 8), '/B', substr(upper(h), 9, 9), '/', h)", "concat('https://hooks.slack', '.com/services/T1/B1/', h)"),
    "stripe_key": ("concat('sk', '_live_', substr(h, 1, 20))", "concat('sk', '_prod_', h)"),
    "google_api_key": ("concat('AI', 'za', h, substr(h, 1, 3))", "concat('AI', 'za', substr(h, 1, 30))"),
    "sendgrid_key": ("concat('SG', '.', substr(h, 1, 22), '.', h, substr(h, 1, 11))", "concat('SG', '.', substr(h, 1, 10))"),
    "twilio_key": ("concat('S', 'K', h)", "concat('S', 'K', upper(h))"),
    "npm_token": ("concat('np', 'm_', h, substr(h, 1, 4))", "concat('np', 'm_', h)"),
}
_SSN = f"concat({_digits_sql('c_custkey * 7919 % 1000', 3)}, '-', {_digits_sql('c_custkey % 100', 2)}, '-', {_digits_sql('c_custkey * 31 % 10000', 4)})"
_GROUPS = ", ':', ".join(f"substr(h, {4 * i + 1}, {i % 4 + 1})" for i in range(7))
_IPV6 = (
    f"CASE c_custkey % 7 WHEN 0 THEN concat(substr(h, 1, 4), '::', substr(h, 5, 2)) WHEN 1 THEN concat({_GROUPS}, ':', substr(h, 30, 2)) WHEN 2 THEN '10:20:30' WHEN 3 THEN concat(substr(h, 1, 1), '::', substr(h, 2, 1), '::', substr(h, 3, 1)) "
    f"WHEN 4 THEN concat('::', substr(h, 1, 3)) WHEN 5 THEN concat({_GROUPS}, '::') ELSE concat(':', {_GROUPS}) END"
)


def _made_sql(text: str) -> str:
    return f"(SELECT c_custkey, {text} AS text FROM (SELECT c_custkey, {_H} AS h FROM customer))"


def _customers(spark, sf_dir, text: str) -> DataFrame:
    """c_custkey and a text made from it."""
    return _read(spark, sf_dir, "customer", "c_custkey").withColumn("h", F.expr(_H)).select("c_custkey", F.expr(text).alias("text"))


def _fixture(kind: str, text: str):
    i, shape = _shape(kind)
    return lambda spark, sf_dir: _found(_customers(spark, sf_dir, text), "c_custkey", tiers.shape_spans("text", shape, i))


for _kind, (_good, _bad) in _MADE.items():
    _text = f"concat('see ', CASE WHEN c_custkey % 3 = 1 THEN {_bad} ELSE {_good} END, ' here')"
    QUERIES[f"fixture_{_kind}"] = _fixture(_kind, _text)
    ORACLE[f"fixture_{_kind}"] = f"WITH m AS (SELECT c_custkey, unnest(regexp_extract_all(text, {_quoted(_shape(_kind)[1].regex)})) AS m FROM {_made_sql(_text)}) SELECT c_custkey, m AS match, count(*) AS n FROM m GROUP BY ALL"
_SSN_TEXT = f"concat('id ', {_SSN}, CASE WHEN c_custkey % 5 = 0 THEN '-1 ' ELSE '. ' END, {_SSN})"
QUERIES["fixture_ssn"] = _fixture("ssn", _SSN_TEXT)
ORACLE["fixture_ssn"] = (
    f"WITH m AS (SELECT c_custkey, unnest(regexp_extract_all(text, '[0-9-]+')) AS m FROM {_made_sql(_SSN_TEXT)}) SELECT c_custkey, m AS match, count(*) AS n FROM m "
    "WHERE regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND m[1:3] NOT IN ('000', '666') AND m[1:1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000' GROUP BY ALL"
)
_IPV6_OK = (
    "((len(string_split(t, ':')) = 8 AND NOT list_contains(string_split(t, ':'), '')) OR (len(t) - len(replace(t, '::', '')) = 2 AND NOT contains(t, ':::') "
    "AND NOT regexp_matches(t, '^:[^:]') AND NOT regexp_matches(t, '[^:]:$') AND len(list_filter(string_split(t, ':'), lambda g: g <> '')) <= 7))"
)
_IPV6_TEXT = f"concat('at ', {_IPV6}, ' up')"
QUERIES["fixture_ipv6"] = _fixture("ipv6", _IPV6_TEXT)
ORACLE["fixture_ipv6"] = (
    rf"WITH m AS (SELECT c_custkey, unnest(regexp_extract_all(text, '(?:^|[^\w:.])([0-9A-Fa-f]{{0,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}})(?:[^\w:]|$)', 1)) AS t FROM {_made_sql(_IPV6_TEXT)}) "
    f"SELECT c_custkey, t AS match, count(*) AS n FROM m WHERE {_IPV6_OK} GROUP BY ALL"
)
_BARE = (
    "concat(CASE c_custkey % 5 WHEN 0 THEN 'Social Security ' WHEN 1 THEN 'order ' WHEN 2 THEN 'ssn of a customer, which nobody is to see or to keep, is this: ' WHEN 3 THEN 'his SSN: ' ELSE 'social insecurity ' END, "
    f"{_digits_sql('c_custkey * 7919 % 1000000000', 9)}, ' end')"
)


@query(
    "contextual_ssn",
    f"""WITH t AS (SELECT c_custkey, text, regexp_extract(text, '[0-9]{{9}}') AS m FROM {_made_sql(_BARE)}), p AS (SELECT *, strpos(text, m) - 1 AS start FROM t),
    w AS (SELECT *, lower(text[greatest(start - 48, 0) + 1 : start]) AS before FROM p)
    SELECT c_custkey, CAST(start AS INT) AS start, m AS match, CAST(1 AS DOUBLE) AS confidence FROM w WHERE contains(before, 'ssn') OR contains(before, 'social security') OR contains(before, 'social-security')""",
)
def contextual_ssn(spark, sf_dir):
    """Nine bare digits, which count only shortly after a word of social security."""
    spans = Masker(types=("ssn",)).spans(_customers(spark, sf_dir, _BARE), ["c_custkey"])
    return spans.select("c_custkey", "start", F.col("text").alias("match"), F.round("confidence", 6).alias("confidence"))


# ---- validators and scalar functions ------------------------------------------------------------


def _scalar(name: str, text: str, function: Callable[[Column], Column], sql: str, places: int | None = None) -> None:
    def run(spark, sf_dir):
        value = function(F.col("text"))
        return _customers(spark, sf_dir, text).select("c_custkey", F.col("text").alias("t"), (value if places is None else F.round(value, places)).alias("value"))

    QUERIES[name] = run
    ORACLE[name] = f"SELECT c_custkey, t, {sql} AS value FROM (SELECT c_custkey, text AS t FROM {_made_sql(text)})"


_luhn = _LUHN_SQL.replace("d[", "string_split(regexp_replace(t, '[^0-9]', '', 'g'), '')[").replace("len(d)", "len(regexp_replace(t, '[^0-9]', '', 'g'))")
_CARD = "cast(4000000000000000 + c_custkey * 104729 AS string)"
_CARDS = f"CASE c_custkey % 4 WHEN 0 THEN substr({_CARD}, 1, 12) WHEN 1 THEN concat(substr({_CARD}, 1, 4), ' ', substr({_CARD}, 5, 4), '-', substr({_CARD}, 9, 8)) WHEN 2 THEN concat({_CARD}, '000', substr(h, 1, 1)) ELSE {_CARD} END"
_PHONES = (
    f"CASE c_custkey % 5 WHEN 0 THEN concat('+1 415 555 ', {_digits_sql('c_custkey', 4)}) WHEN 1 THEN concat('20', {_digits_sql('c_custkey % 30', 2)}, '-01-02') WHEN 2 THEN {_SSN} "
    f"WHEN 3 THEN cast(c_custkey * 7919 AS string) ELSE concat('(415) ', {_digits_sql('c_custkey * 104729', 9)}, ' 12 34') END"
)
_RUNS = "CASE c_custkey % 4 WHEN 0 THEN h WHEN 1 THEN substr(h, 1, cast(c_custkey % 9 AS int)) WHEN 2 THEN concat('é', substr(h, 1, 3), 'éà') ELSE cast(c_custkey AS string) END"
_scalar("validator_luhn", _CARDS, V.luhn_ok, f"len(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND {_luhn}")
_scalar("validator_ssn", _SSN, V.ssn_ok, "t[1:3] NOT IN ('000', '666') AND t[1:1] <> '9' AND t[5:6] <> '00' AND t[8:11] <> '0000'")
_scalar("validator_phone", _PHONES, V.phone_ok, _PHONE_OK.replace("(m,", "(t,"))
_scalar("validator_ipv6", _IPV6, V.ipv6_ok, _IPV6_OK)
_scalar("shannon_entropy", _RUNS, V.shannon_entropy, "CASE WHEN t = '' THEN 0.0 ELSE round(list_entropy(string_split(t, '')), 6) END", 6)


# ---- scoring ------------------------------------------------------------------------------------


def _email_spans(spark, sf_dir, **options) -> DataFrame:
    return Masker(types=("email",), **options).spans(_read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])


#: Emails with their places: gaps and matches add up to the text.
_EMAIL_ROWS = f"""
WITH e AS (SELECT doc_id, text, regexp_extract_all(text, '{EMAIL}') AS ms FROM documents),
g AS (SELECT *, string_split_regex(text, '{EMAIL}') AS gaps FROM e WHERE len(ms) > 0),
p AS (SELECT doc_id, text, i, ms[i] AS m, list_sum(list_transform(range(1, i + 1), lambda k: len(gaps[k]))) + coalesce(list_sum(list_transform(range(1, i), lambda k: len(ms[k]))), 0) AS start
      FROM g, unnest(range(1, len(ms) + 1)) AS u(i)),
c AS (SELECT doc_id, i - 1 AS ord, m, CAST(start AS INT) AS start, lower(text[greatest(start - 48, 0) + 1:start]) AS wide, lower(text[greatest(start - 16, 0) + 1:start]) AS narrow FROM p),
s AS (SELECT *, wide SIMILAR TO '(?s).*(email|e-mail|mail|contact).*' AS up, (narrow SIMILAR TO '(?s).*(example|sample|dummy|test|fake|placeholder|lorem|xxx-xx).*'
      OR lower(m) SIMILAR TO '(?s).*(example|sample|dummy|test|fake|placeholder|lorem|xxx-xx).*') AS down FROM c),
r AS (SELECT *, least(1.0::DOUBLE, 0.95::DOUBLE + CASE WHEN up THEN 0.2::DOUBLE ELSE 0 END) - CASE WHEN down THEN 0.4::DOUBLE ELSE 0 END AS confidence FROM s)
"""


@query("context_boost", _EMAIL_ROWS + "SELECT up AS boosted, count(*) AS n FROM r GROUP BY ALL")
def context_boost(spark, sf_dir):
    from quillmask.operators.scoring import boosted

    found = Masker(types=("email",)).candidates(_read(spark, sf_dir, "documents", "doc_id", "text"), out="c")
    return exploded(found, ["text"], "c", "s").groupBy(tiers.paged(F.col("text"), lambda pages: boosted(pages, F.col("s"))).alias("boosted")).agg(F.count("*").alias("n"))


@query("context_suppress", _EMAIL_ROWS + "SELECT down AS suppressed, count(*) AS n FROM r GROUP BY ALL")
def context_suppress(spark, sf_dir):
    from quillmask.operators.scoring import suppressed

    found = Masker(types=("email",)).candidates(_read(spark, sf_dir, "documents", "doc_id", "text"), out="c")
    return exploded(found, ["text"], "c", "s").groupBy(tiers.paged(F.col("text"), lambda pages: suppressed(pages, F.col("s"))).alias("suppressed")).agg(F.count("*").alias("n"))


@query("confidence_filter", _EMAIL_ROWS + 'SELECT doc_id, start, m AS text, round(confidence, 6) AS confidence FROM r WHERE confidence >= 0.6')
def confidence_filter(spark, sf_dir):
    return _email_spans(spark, sf_dir, min_confidence=0.6).select("doc_id", "start", "text", F.round("confidence", 6).alias("confidence"))


@query("email_spans", _EMAIL_ROWS + 'SELECT doc_id, start, CAST(start + len(m) AS INT) AS "end", m AS text, round(confidence, 6) AS confidence, CASE WHEN down THEN \'suppressed\' WHEN up THEN \'boosted\' END AS context FROM r')
def email_spans(spark, sf_dir):
    return _email_spans(spark, sf_dir).select("doc_id", "start", "end", "text", F.round("confidence", 6).alias("confidence"), F.col("meta")["context"].alias("context"))


@query(
    "resolve_overlaps",
    """WITH RECURSIVE i AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 97 AS INT) AS s, CAST(l_partkey % 97 + 1 + l_suppkey % 19 AS INT) AS e, l_linenumber % 3 / 4 + 0.25 AS c, CAST(l_linenumber AS INT) AS o FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, s - e, s, o) AS k FROM i),
    m AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(s INT, e INT, c DOUBLE, o INT)[]) AS kept FROM i
      UNION ALL SELECT m.doc_id, r.k, CASE WHEN len(list_filter(m.kept, lambda x: x.s < r.e AND r.s < x.e)) = 0
        THEN list_append(m.kept, CAST({'s': r.s, 'e': r.e, 'c': r.c, 'o': r.o} AS STRUCT(s INT, e INT, c DOUBLE, o INT))) ELSE m.kept END
      FROM m JOIN r ON r.doc_id = m.doc_id AND r.k = m.k + 1),
    f AS (SELECT doc_id, arg_max(kept, k) AS kept FROM m GROUP BY doc_id)
    SELECT doc_id, x.s AS start, x.e AS "end", round(x.c, 6) AS confidence, x.o AS ord FROM (SELECT doc_id, unnest(kept) AS x FROM f)""",
)
def resolve_overlaps(spark, sf_dir):
    """Intervals made from order lines, a few an order; SQL takes them one by one in order of rank."""
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    start = (F.col("l_partkey") % 97).cast("int")
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 1 + F.col("l_suppkey") % 19).cast("int").alias("end"), (F.col("l_linenumber") % 3 / 4 + 0.25).alias("confidence"), F.col("l_linenumber").cast("int").alias("ord"))
    return resolved_rows(rows, ["doc_id"]).select("doc_id", "start", "end", F.round("confidence", 6).alias("confidence"), "ord")


# ---- rewriting ----------------------------------------------------------------------------------


def _redacted(spark, sf_dir, **policy) -> DataFrame:
    masker = Masker(types=("email",), policy=Policy(**policy))
    return masker.redact(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "redacted")


_EACH = "list_reduce(list_concat([text], list_distinct(regexp_extract_all(text, '" + EMAIL + "'))), lambda a, m: replace(a, m, {shown}))"
_KEY = b"a key for tests"
_INNER, _OUTER = ("".join(f"{b ^ pad:02x}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C))
_HMAC = f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(m))))"

QUERIES["redact_replace"] = lambda spark, sf_dir: _redacted(spark, sf_dir)
ORACLE["redact_replace"] = f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[REDACTED]', 'g') AS redacted FROM documents"
QUERIES["redact_mask"] = lambda spark, sf_dir: _redacted(spark, sf_dir, mode="mask")
ORACLE["redact_mask"] = f"SELECT doc_id, {_EACH.replace("{shown}", "repeat('*', len(m) - 4) || m[-4:]")} AS redacted FROM documents"
QUERIES["redact_pseudonymize"] = lambda spark, sf_dir: _redacted(spark, sf_dir, mode="pseudonymize", hmac_key=_KEY)
ORACLE["redact_pseudonymize"] = f"SELECT doc_id, {_EACH.replace("{shown}", f"'<EMAIL_' || ({_HMAC})[1:10] || '>'")} AS redacted FROM documents"
QUERIES["redact_per_type"] = lambda spark, sf_dir: _redacted(spark, sf_dir, mode="mask", replacements={"email": "<EMAIL>"})
ORACLE["redact_per_type"] = f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g') AS redacted FROM documents"


@query("redact_conversations", "SELECT conv_id, turn, text AS redacted FROM conversations")
def redact_conversations(spark, sf_dir):
    return Masker().redact(_read(spark, sf_dir, "conversations", "conv_id", "turn", "text")).select("conv_id", "turn", "redacted")


@query("redact_documents")
def redact_documents(spark, sf_dir):
    """All tiers over all documents: how many detections each has and its rewritten text."""
    return Masker().redact(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", F.size("detections").alias("n_spans"), "redacted")


# ---- custom text and Python detectors -----------------------------------------------------------


@query("custom_words", "SELECT doc_id, regexp_replace(text, '(?i)apache license|licensed', '[REDACTED]', 'g') AS redacted FROM documents")
def custom_words(spark, sf_dir):
    masker = Masker(types=(), custom_words=("Apache License", "licensed"))
    return masker.redact(_read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "redacted")


@query(
    "custom_word_list",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS w FROM benchmark),
    p AS (SELECT '(?i)' || string_agg(w, '|' ORDER BY w) AS p FROM w), m AS (SELECT doc_id, unnest(regexp_extract_all(text, p)) AS m FROM documents, p)
    SELECT doc_id, m AS match, count(*) AS n FROM m GROUP BY ALL""",
)
def custom_word_list(spark, sf_dir):
    """A list of many words, those of seven letters and more in the benchmark, anywhere in documents."""
    found = _read(spark, sf_dir, "benchmark", "text").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0))).alias("w")).distinct()
    words = sorted(r["w"] for r in found.collect())  # the user's list; its automaton's size is checked
    spans = Masker(types=(), load_plugins=False, custom_words=words).spans(_read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return spans.groupBy("doc_id", F.col("text").alias("match")).agg(F.count("*").alias("n"))


def _python(spark, sf_dir, **options) -> DataFrame:
    spans = Masker(types=(), load_plugins=False, **options).spans(_read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return spans.groupBy("doc_id", F.col("text").alias("match"), "entity_type").agg(F.count("*").alias("n"))


def _python_sql(regex: str, kind: str) -> str:
    return f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{regex}')) AS m FROM documents) SELECT doc_id, m AS match, '{kind}' AS entity_type, count(*) AS n FROM m GROUP BY ALL"


@query("custom_regex_udf", _python_sql(r"(?i)version [0-9]+\.[0-9]+", "custom"))
def custom_regex_udf(spark, sf_dir):
    return _python(spark, sf_dir, custom_patterns=(r"version [0-9]+\.[0-9]+",))


class WordDetector:
    """A detector of one literal word, as a plugin would bring."""

    name = "plugin"

    def __init__(self, word: str = "Apache", kind: str = "custom", confidence: float = 1.0):
        self.word, self.kind, self.confidence = word, kind, confidence

    def detect(self, text: str) -> list[Span]:
        found = CustomDetector((self.word,), case_sensitive=True).detect(text)
        return [Span(s.start, s.end, s.text, self.kind, self.confidence, self.name) for s in found]


@query("plugin_udf", _python_sql("Apache", "custom"))
def plugin_udf(spark, sf_dir):
    ship_package(spark)
    return _python(spark, sf_dir, extra_detectors=(WordDetector(),))


@query(
    "ner_stub",
    f"""WITH p AS (SELECT doc_id, text, unnest(list_transform(range(1, len(gaps)), lambda i: len(array_to_string(gaps[1:i], 'License')))) AS s
      FROM (SELECT doc_id, text, string_split(text, 'License') AS gaps FROM documents))
    SELECT doc_id, 'License' AS match, 'org' AS entity_type, count(*) AS n FROM p
    WHERE NOT regexp_matches(lower(text[greatest(s - 16, 0) + 1 : s]), '{_PLACEHOLDERS}') GROUP BY ALL""",
)
def ner_stub(spark, sf_dir):
    """The place of a language model, taken by a detector of one word with the model's confidence of 0.7:
    near a placeholder word it is 0.3, under the threshold."""
    return _python(spark, sf_dir, extra_detectors=(WordDetector("License", "org", 0.7),))


# ---- summaries ----------------------------------------------------------------------------------

_COUNTED = f"""
WITH f AS (SELECT doc_id, lang, source, 'email' AS entity_type, unnest(regexp_extract_all(text, '{EMAIL}')) AS m FROM documents
UNION ALL SELECT doc_id, lang, source, 'ipv4', unnest({_IPV4_SQL}) FROM documents
UNION ALL SELECT doc_id, lang, source, 'credit_card', m FROM (SELECT *, string_split({_DIGITS}, '') AS d FROM (SELECT doc_id, lang, source, unnest({_CARD_SQL}) AS m FROM documents))
  WHERE len(d) BETWEEN 13 AND 19 AND {_LUHN_SQL})
"""
_COUNTED_TYPES = ("email", "ipv4", "credit_card")
_OF_ROW = "row_no, doc_id, lang, source, text"
#: What is detected: of spans that overlap, such as a card and the first octet behind it, the surest is kept.
_DETECTED = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_no, * FROM documents),
f AS (SELECT *, 'email' AS entity_type, 0.95::DOUBLE AS sure, 'email|e-mail|mail|contact' AS words, 0 AS ord FROM {_emails_sql("d", _OF_ROW)}
  UNION ALL SELECT *, 'credit_card', 0.9, 'card|visa|mastercard|amex|cc|payment', 1 FROM {_cards_sql("d", _OF_ROW)}
  UNION ALL SELECT *, 'ipv4', 0.9, 'ip|host|server|addr', 2 FROM {_ipv4_sql("d", _OF_ROW)}),
b AS (SELECT *, CASE WHEN regexp_matches(lower(text[greatest(s - 48, 0) + 1 : s]), words) THEN least(1.0::DOUBLE, sure + 0.2::DOUBLE) ELSE sure END AS raised,
  regexp_matches(lower(text[greatest(s - 16, 0) + 1 : s]), '{_PLACEHOLDERS}') OR regexp_matches(lower(m), '{_PLACEHOLDERS}') AS down FROM f),
c AS (SELECT *, s + len(m) AS e, CASE WHEN down THEN greatest(0.0::DOUBLE, raised - 0.4::DOUBLE) ELSE raised END AS confidence FROM b),
l AS (SELECT row_no, doc_id, lang, source, list([{{'s': s, 'e': e, 't': entity_type}}] ORDER BY confidence DESC, s - e, s, ord) AS spans FROM c WHERE confidence >= 0.5 GROUP BY ALL),
k AS (SELECT doc_id, lang, source, unnest(list_reduce(list_concat([CAST([] AS STRUCT(s BIGINT, e BIGINT, t VARCHAR)[])], spans), lambda a, x:
  CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) = 0 THEN list_concat(a, x) ELSE a END)).t AS entity_type FROM l)
"""


def _by_type(spark, sf_dir, masker: Masker) -> DataFrame:
    return masker.summary(_read(spark, sf_dir, "documents", "doc_id", "text"))


def _by_lang_source(spark, sf_dir, masker: Masker) -> DataFrame:
    return masker.summary(_read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), ["lang", "source"])


def _by_label(spark, sf_dir, masker: Masker) -> DataFrame:
    found = masker.spans(_read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return found.join(_read(spark, sf_dir, "labels", "doc_id", "toxic"), "doc_id").groupBy("toxic", "entity_type").agg(F.count("*").alias("n"))


# SQL has no form of context, entropy and overlaps; the tests hold all types against LocalEngine.


@query("summary_by_type")
def summary_by_type(spark, sf_dir):
    return _by_type(spark, sf_dir, Masker())


@query("summary_by_lang_source")
def summary_by_lang_source(spark, sf_dir):
    return _by_lang_source(spark, sf_dir, Masker())


@query("summary_by_label")
def summary_by_label(spark, sf_dir):
    return _by_label(spark, sf_dir, Masker())


@query("email_ipv4_card_by_type", _DETECTED + "SELECT entity_type, count(*) AS n FROM k GROUP BY ALL")
def email_ipv4_card_by_type(spark, sf_dir):
    return _by_type(spark, sf_dir, Masker(types=_COUNTED_TYPES))


@query("email_ipv4_card_by_lang_source", _DETECTED + "SELECT lang, source, entity_type, count(*) AS n FROM k GROUP BY ALL")
def email_ipv4_card_by_lang_source(spark, sf_dir):
    return _by_lang_source(spark, sf_dir, Masker(types=_COUNTED_TYPES))


@query("email_ipv4_card_by_label", _DETECTED + "SELECT toxic, entity_type, count(*) AS n FROM k JOIN labels USING (doc_id) GROUP BY ALL")
def email_ipv4_card_by_label(spark, sf_dir):
    return _by_label(spark, sf_dir, Masker(types=_COUNTED_TYPES))


@query("types_filter", _COUNTED + "SELECT doc_id, m AS match, count(*) AS n FROM f WHERE entity_type = 'ipv4' GROUP BY ALL")
def types_filter(spark, sf_dir):
    found = Masker(types=("ipv4",)).spans(_read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])
    return found.groupBy("doc_id", F.col("text").alias("match")).agg(F.count("*").alias("n"))


@query("sql_detect", _EMAIL_ROWS + 'SELECT doc_id, start, CAST(start + len(m) AS INT) AS "end", m AS match, round(confidence, 6) AS confidence FROM r')
def sql_detect(spark, sf_dir):
    """The table function in SQL, a row a detection."""
    register_sql(spark, Masker(types=("email",)))
    found = spark.sql("SELECT d.doc_id, s.* FROM {documents} d, LATERAL quill_detect(d.text) s", documents=_read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "start", "end", F.col("text").alias("match"), F.round("confidence", 6).alias("confidence"))


@query(
    "email_listing",
    _EMAIL_ROWS
    + """SELECT CAST(to_json({'type': 'email', 'start': start, 'end': CAST(start + len(m) AS INT), 'text': m, 'confidence': round(confidence, 3), 'source': 'deterministic'}) AS VARCHAR) AS json,
    format('{:>13}  conf={:.2f}  {}{}{}', 'email', confidence, chr(39), m, chr(39)) AS line FROM r""",
)
def email_listing(spark, sf_dir):
    """Emails of all documents in both formats of a listing."""
    return _email_spans(spark, sf_dir).select(files.json_line().alias("json"), files.text_line().alias("line"))


@query("detect_listing")
def detect_listing(spark, sf_dir):
    """Detections of all tiers as JSON lines."""
    return files.listing_json(Masker().spans(_read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"]))


# ---- ranges, chunks and scores ------------------------------------------------------------------


@query("halo_equivalence", ORACLE["redact_replace"])
def halo_equivalence(spark, sf_dir):
    """Documents cut in ranges of 2,000 characters with margins, put together again."""
    return halo.halo_redact(_read(spark, sf_dir, "documents", "doc_id", "text"), Masker(types=("email",)), 2000, 256).select("doc_id", "redacted")


@query("file_ranges", "SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def file_ranges(spark, sf_dir):
    """All documents written as one text file by many tasks, and read back in ranges of 1 MB: its lines."""
    documents = _read(spark, sf_dir, "documents", "text").filter("text is not null")
    content = F.concat(F.col("text"), F.lit("\n")).cast("binary")
    folder = f"{shared_folder(spark)}/quillmask/{spark.sparkContext.applicationId}/file-{uuid.uuid4().hex}"
    ranges.write_files(documents.select(F.lit("documents.txt").alias("path"), F.monotonically_increasing_id().alias("seg_no"), content.alias("content")), folder)
    read = ranges.read_ranges(spark, f"{folder}/documents.txt", 1 << 20, keep_newlines=True)
    # A range that ends a line leaves an empty string behind it; the file ends its last line.
    lines = read.select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"), F.length("text").alias("size")).filter("size > 0")
    return lines.groupBy(F.md5(F.encode("line", "UTF-8")).alias("line_md5")).agg(F.count("*").alias("n"))


def _chunks(documents: DataFrame, width: int) -> DataFrame:
    """Chunks of ``width`` characters, the last one marked, each third one twice, and one after the end."""
    # One pass cuts a text; a text without characters, or none, is one chunk.
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    parts = documents.select("doc_id", F.when(F.size(cut) > 0, cut).otherwise(F.array("text")).alias("parts"))
    last = F.size("parts") - 1
    part = lambda t, i: F.struct(i.cast("long").alias("chunk_no"), t.alias("text"), (i == last).alias("is_last"))
    late = F.struct((last + 1).cast("long").alias("chunk_no"), F.lit(" late@corp.io").alias("text"), F.lit(False).alias("is_last"))
    chunks = F.transform("parts", part)
    parts = parts.select("doc_id", F.explode(F.concat(chunks, F.filter(chunks, lambda c: c["chunk_no"] % 3 == 0), F.array(late))).alias("c"))
    return parts.select("doc_id", "c.*")


def _whole(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id and redacted, put together from segments."""
    rows = segments.select("doc_id", "seg_no", "redacted").unionByName(documents.select("doc_id", F.lit(-1).alias("seg_no"), F.when(F.col("text").isNotNull(), "").alias("redacted")))
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", "redacted")))
    return rows.groupBy("doc_id").agg(F.when(F.count("redacted") > 0, F.array_join(F.transform(ordered, lambda s: s["redacted"]), "")).alias("redacted"))


@query("stream_chunks", ORACLE["redact_replace"])
def stream_chunks(spark, sf_dir):
    """Documents as chunks of 700 characters, some repeated and some late, searched in ranges of 2,000."""
    documents = _read(spark, sf_dir, "documents", "doc_id", "text")
    return _whole(documents, chunks.redact_chunk_table(_chunks(documents, 700), settings(types=("email",), overlap=256), 2000))


@query("chunk_table_all")
def chunk_table_all(spark, sf_dir):
    """The same with all tiers: each document's segments and detections."""
    documents = _read(spark, sf_dir, "documents", "doc_id", "text")
    found = chunks.redact_chunk_table(_chunks(documents, 1000), settings(), 8192)
    return found.select("doc_id", "seg_no", "base_offset", F.size("detections").alias("n_spans"), "redacted")


@query(
    "score_prf",
    """WITH RECURSIVE p AS (SELECT l_orderkey AS doc_id, l_returnflag AS t, l_partkey % 61 AS a, l_partkey % 61 + 3 + l_suppkey % 17 AS b FROM lineitem),
    g AS (SELECT l_orderkey AS doc_id, l_returnflag AS t, (l_partkey * 7 + l_linenumber) % 61 AS c, (l_partkey * 7 + l_linenumber) % 61 + 2 + l_suppkey % 5 AS d FROM lineitem),
    pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY a, b) AS k FROM p),
    gj AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY c, d) AS j FROM g),
    n AS (SELECT pk.doc_id, pk.t, pk.k, list(j ORDER BY j DESC) FILTER (j IS NOT NULL) AS js FROM pk LEFT JOIN gj
      ON pk.doc_id = gj.doc_id AND pk.t = gj.t AND least(b, d) > greatest(a, c) AND least(b, d) - greatest(a, c) >= 0.5 * (d - c) GROUP BY ALL),
    m AS (SELECT DISTINCT doc_id, t, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used FROM p
      UNION ALL SELECT m.doc_id, m.t, n.k, list_concat(m.used, list_filter(coalesce(n.js, []), lambda x: NOT list_contains(m.used, x))[1:1])
      FROM m JOIN n ON n.doc_id = m.doc_id AND n.t = m.t AND n.k = m.k + 1),
    h AS (SELECT doc_id, t, max(len(used)) AS tp FROM m GROUP BY ALL),
    c AS (SELECT t, sum(p) AS p, sum(g) AS g, sum(m) AS m FROM (SELECT t, 1 AS p, 0 AS g, 0 AS m FROM p UNION ALL SELECT t, 0, 1, 0 FROM g UNION ALL SELECT t, 0, 0, tp FROM h) GROUP BY ROLLUP (t))
    SELECT coalesce(t, 'all') AS entity_type, CAST(m AS BIGINT) AS tp, CAST(p - m AS BIGINT) AS fp, CAST(g - m AS BIGINT) AS fn,
      round(m / p, 6) AS "precision", round(m / g, 6) AS recall, round(2 * m / (p + g), 6) AS f1 FROM c""",
)
def score_prf(spark, sf_dir):
    """Predictions and gold spans made from order lines, a few of each an order; one overlaps several of
    the others."""
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_partkey", "l_suppkey", "l_linenumber")

    def spans(start: Column, size: Column) -> DataFrame:
        return lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("entity_type"), start.alias("start"), (start + size).alias("end"))

    predicted = spans(F.col("l_partkey") % 61, 3 + F.col("l_suppkey") % 17)
    gold = spans((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 61, 2 + F.col("l_suppkey") % 5)
    rated = evaluate.scores(predicted, gold, ["doc_id"])
    return rated.select("entity_type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
