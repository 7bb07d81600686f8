"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is DataFrame functions. Patterns are written so that Java's engine runs over a text in linear time and
without recursion: runs are possessive, and a run that failed at its start isn't tried again from its middle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, then the kinds that this operator adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")

#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}


def _iban(country: str, length: int) -> str:
    return rf"\b{country}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}+(?![A-Z0-9])"


PATTERNS = {
    # \G: a match may start where the last one ended, although the run of local characters began before it.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "|".join(_iban(c, n) for c, n in IBAN_LENGTHS.items()),
    "ssn": r"(?:\G|(?<![0-9-]))[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # keys by the beginnings that their issuers give them, and whatever is assigned to a name that says so
    "secret": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+|\bsk-[A-Za-z0-9_-]{20,}+|\bxox[abprs]-[A-Za-z0-9-]{10,}+|\bAIza[A-Za-z0-9_-]{35}"
    r"|(?i:\b(?:api[_-]?key|secret|token|passw(?:or)?d)\x20?[:=]\x20?[\x22\x27]?)[A-Za-z0-9_+/=-]{8,}+",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
#: A key holds letters and digits, and at least so many different characters.
KEY_CHARS = 8
#: Score of a confirmed span, and what a context word within CONTEXT_CHARS adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.7}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "server|host|address|login",
    "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto",
    "ssn": "ssn|social|security",
    "secret": "key|secret|token|password|credential",
}
CONTEXT_CHARS, CONTEXT_SCORE, LEAST_SCORE = 40, 0.3, 0.5
_SPAN = "struct<start:bigint,end:bigint,value:string>"


def _has(text: Column, kind: str) -> Column:
    return text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")


def _digit_sum(digits: Column) -> Column:
    """Luhn: from the right, every second digit is doubled and its digits are summed."""

    def worth(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        return F.coalesce(F.when(i % 2 == 0, d).otherwise((2 * d) % 10 + F.floor(2 * d / 10).cast("int")), F.lit(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x)


def _mod97(value: Column) -> Column:
    """The remainder of an account number, its first four characters moved to the end and letters read as 10 to 35."""
    compact = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code == 0, rest).when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _confirms(kind: str):
    return lambda span: _confirmed(kind, span["value"])


def _scores(kind: str, body: Column):
    """From a placed span to a scored one: words within CONTEXT_CHARS of it raise the score."""

    def scored(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)).cast("int")
        around = F.lower(F.substring(body, first + 1, (s["end"] - first + CONTEXT_CHARS).cast("int")))
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(around.rlike(CONTEXT[kind]), CONTEXT_SCORE).otherwise(0.0))
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), s["end"].alias("end"), score.alias("score"))

    return scored


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & (_digit_sum(digits) % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _mod97(value) == 1
    if kind == "secret":
        key = F.regexp_replace(value, r"^[^:=]*[:=]\x20?[\x22\x27]?", "")
        return key.rlike("[A-Za-z]") & key.rlike("[0-9]") & (F.size(F.array_distinct(F.split(key, ""))) >= KEY_CHARS)
    return F.lit(True)


def _placed(gaps: Column, values: Column) -> Column:
    """Spans from the texts before each match and the matches: a running sum of their lengths in code points."""
    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(F.length(g).cast("long").alias("gap"), v.alias("value")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"]).cast("long")
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as array<{_SPAN}>)").alias("spans"))
    return F.aggregate(pairs, zero, step)["spans"]


def _unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores in front as it takes that no column begins with it."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name


def find_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """df with the column `into`: array of (start, kind_no, kind, end, score), by start, then kind; code points, end exclusive.

    Null and empty texts have no spans; an empty table stays empty; texts of any length are searched whole. Repeated rows and
    extra columns stay as they are, but a column `into` is replaced. Base kinds are kept whatever their score; the kinds added on top need
    LEAST_SCORE. A match that its checksum refuses is dropped, and its text isn't searched again.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    own = _unused(df, "_pii_")
    out = df.withColumns({f"{own}m_{k}": F.when(_has(body, k), F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) for k in KINDS})
    out = out.withColumns({f"{own}g_{k}": F.when(F.size(f"{own}m_{k}") > 0, F.split(body, PATTERNS[k], -1)).otherwise(none) for k in KINDS})
    out = out.withColumns({f"{own}s_{k}": _placed(F.col(f"{own}g_{k}"), F.col(f"{own}m_{k}")) for k in KINDS})
    kinds = []
    for k in KINDS:
        spans = F.transform(F.filter(f"{own}s_{k}", _confirms(k)), _scores(k, body))
        kinds.append(spans if k in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE))
    out = out.withColumn(into, F.array_sort(F.concat(*kinds)))
    return out.drop(*(f"{own}{a}_{k}" for a in "mgs" for k in KINDS))


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of personal data replaced by its kind in brackets; spans that overlap become one.

    Null texts stay null, repeated rows and all other columns as they are, whatever their names; an empty table stays empty.
    """
    spans = _unused(df, "_spans_")
    found, merged = find_pii(df, text, spans), spans + "u"

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        over = (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        piece = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(over, F.array_append(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.array_append(acc, piece))

    found = found.withColumn(merged, F.aggregate(spans, F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:string>>)"), join))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda s: s["end"]))
    pieces = F.zip_with(merged, F.slice(ends, 1, F.size(merged)), lambda s, e: F.concat(F.substring(F.col(text), (e + 1).cast("int"), (s["start"] - e).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = F.substring(F.col(text), (F.element_at(ends, -1) + 1).cast("int"), F.length(F.col(text)))
    return found.withColumn(text, F.when(F.size(merged) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text))).drop(spans, merged)


def digest(df: DataFrame) -> DataFrame:
    """The columns that the query returns, from `pii`."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["kind_no"] < len(BASE_KINDS))
    counts = [F.size(F.filter("pii", _is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return df.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"))
