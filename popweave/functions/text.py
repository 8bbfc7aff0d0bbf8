"""Record <-> text as native column expressions (no Python UDFs).

Serialization builds ``"<Display> is <value>"`` pieces with ``concat_ws``;
permutation sorts the pieces by a seeded md5 key per (row, attribute), so the
order is a function of the data, never of partitioning.  Parsing is a chain
of ``regexp_replace`` / ``split`` / higher-order ``filter``/``transform``
with first-wins lookups through ``get(filter(...), 0)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popweave.domain import DEFAULT_REGION, DEFAULT_SEED, DISPLAY_NAMES

# --- fixed values: era narratives by year (must equal the reference's) -----
ERA_NARRATIVES: dict[int, str] = {
    1990: (
        "In 1990, South Korea had a TFR of 1.57 and rapid industrialization. "
        "The elderly (65+) were only 5.1% of the population. "
        "University enrollment was expanding but most adults had high school education or less."
    ),
    1995: (
        "In 1995, South Korea's TFR dropped to 1.63 amid economic growth. "
        "The elderly share rose to 5.9%. Manufacturing employment peaked "
        "and the service sector expanded rapidly."
    ),
    2000: (
        "In 2000, South Korea recovered from the 1997 financial crisis. "
        "TFR fell to 1.47. The elderly were 7.2% of the population. "
        "University education became widespread among young adults."
    ),
    2005: (
        "In 2005, South Korea's TFR plunged to 1.08, one of the world's lowest. "
        "The elderly reached 9.1%. Dual-income households increased "
        "and delayed marriage became common among young adults."
    ),
    2010: (
        "In 2010, South Korea's TFR was 1.23 with an aging society. "
        "The elderly constituted 11.0%. Professional and service occupations "
        "grew while agriculture continued declining."
    ),
    2015: (
        "In 2015, South Korea's TFR was 1.24 and the elderly reached 13.1%. "
        "Graduate education expanded significantly. "
        "Youth unemployment rose despite high educational attainment."
    ),
    2020: (
        "In 2020, South Korea's TFR hit a record low of 0.84. "
        "The elderly reached 15.7% of the population. "
        "Never-married rates surged among 30-somethings and divorce rates stabilized."
    ),
    2025: (
        "By 2025, South Korea's TFR is projected at 0.75. "
        "The elderly exceed 20% of the population, entering a super-aged society. "
        "Single-person households surpass 35% and educational attainment remains very high."
    ),
    2030: (
        "By 2030, South Korea's TFR is projected at 0.80 with 25.5% elderly. "
        "The working-age population shrinks significantly. "
        "Most young adults hold university degrees and professional jobs dominate."
    ),
    2035: (
        "By 2035, South Korea's population begins declining with TFR at 0.80. "
        "The elderly reach 30.1%. Single-person households approach 40%. "
        "Labor force participation of elderly increases substantially."
    ),
    2040: (
        "By 2040, South Korea's population has declined to 47.7 million with 34.4% elderly. "
        "The child population (0-14) falls below 8%. "
        "Agricultural workers are almost entirely elderly."
    ),
}
RECORD_PREFIX = "In {year}, a resident of {region} was recorded: "
CONTEXT_OPEN = "[Context: "
CONTEXT_CLOSE = "] "
SKIPPED_KEYS = ("year", "region")
# --- end fixed values ------------------------------------------------------

# Characters Python's str.strip() removes (str.isspace), as a Java regex class body.
WS_CHARS = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
WS = f"[{WS_CHARS}]"
CONTEXT_RE = f"(?d)^\\[Context:.*?\\]{WS}*"
SECOND_RECORD_RE = f"(?s)(?:,{WS}*)?In \\p{{Nd}}{{4}}[,{WS_CHARS}].*"
STRIP_RE = f"^{WS}+|{WS}+$"


def era_df(spark: SparkSession) -> DataFrame:
    """The 11-row narrative table ``(year INT, narrative STRING)``."""
    schema = T.StructType([T.StructField("year", T.IntegerType(), False),
                           T.StructField("narrative", T.StringType(), False)])
    return spark.createDataFrame(sorted(ERA_NARRATIVES.items()), schema)


def era_narrative_expr(year: Column) -> Column:
    """Narrative for a year via a literal map (null when the year has none)."""
    m = F.create_map(*[x for y, n in sorted(ERA_NARRATIVES.items()) for x in (F.lit(y), F.lit(n))])
    return F.try_element_at(m, year.cast("int"))


# the same set as literal characters, for trim(): no regex per call
PY_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def py_strip(c: Column) -> Column:
    """``str.strip()``: trim Python's whitespace set from both ends."""
    return F.trim(c, F.lit(PY_WHITESPACE))


def record_prefix(year: Column, region: str = DEFAULT_REGION) -> Column:
    return F.concat(F.lit("In "), year.cast("string"), F.lit(f", a resident of {region} was recorded: "))


def _piece(col: str, dtype: T.DataType, display: Mapping[str, str]) -> Column:
    c = F.col(col)
    present = c.isNotNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        present = present & ~F.isnan(c)
    return F.when(present, F.concat(F.lit(f"{display.get(col, col)} is "), c.cast("string")))


def serialize_body(df: DataFrame, cols: Sequence[str] | None = None, *, permute: bool = False,
                   seed: int = DEFAULT_SEED, key_col: str | None = None,
                   display: Mapping[str, str] | None = None) -> Column:
    """``"A is v, B is w"`` over ``cols`` (default: every column but year/region).

    Null values are omitted.  With ``permute`` the pieces are ordered by
    ``md5('seed:key:attr')`` — uniform per row, reproducible, and independent
    of partitioning (a deviation from a single running generator).
    """
    display = dict(DISPLAY_NAMES) if display is None else dict(display)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = [c for c in (cols or df.columns) if c not in SKIPPED_KEYS]
    pieces = [_piece(c, types[c], display) for c in cols]
    if not permute:
        return F.concat_ws(", ", *pieces)
    if key_col is None:
        raise ValueError("permute=True needs key_col (a unique row key)")
    key = F.col(key_col).cast("string")
    arr = F.array(*[
        F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.lit(c))).alias("k"), p.alias("p"))
        for c, p in zip(cols, pieces)
    ])
    kept = F.filter(arr, lambda s: s["p"].isNotNull())
    return F.array_join(F.transform(F.array_sort(kept), lambda s: s["p"]), ", ")


def serialize(df: DataFrame, cols: Sequence[str] | None = None, *, year_col: str | None = "year",
              region: str = DEFAULT_REGION, permute: bool = False, seed: int = DEFAULT_SEED,
              key_col: str | None = None, use_era_context: bool = False,
              display: Mapping[str, str] | None = None) -> Column:
    """Full serialized text; the prefix appears only when the year is present."""
    if cols is None:
        cols = [c for c in df.columns if c not in (year_col, key_col)]
    body = serialize_body(df, cols, permute=permute, seed=seed, key_col=key_col, display=display)
    if year_col is None or year_col not in df.columns:
        return body
    year = F.col(year_col)
    std = F.concat(record_prefix(year, region), body)
    text = F.when(year.isNotNull(), std).otherwise(body)
    if use_era_context:
        narr = era_narrative_expr(year)
        text = F.when(year.isNotNull() & narr.isNotNull() & (narr != ""),
                      F.concat(F.lit(CONTEXT_OPEN), narr, F.lit(CONTEXT_CLOSE), std)).otherwise(text)
    return text


def era_prefix(year: Column, region: str = DEFAULT_REGION) -> Column:
    """``[Context: <narrative>] In <year>, ...: `` or the standard prefix."""
    narr = era_narrative_expr(year)
    std = record_prefix(year, region)
    return F.when(narr.isNotNull() & (narr != ""),
                  F.concat(F.lit(CONTEXT_OPEN), narr, F.lit(CONTEXT_CLOSE), std)).otherwise(std)


def generation_prefix(year: Column, region: str = DEFAULT_REGION,
                      conditions: Sequence[tuple[str, Column]] = (),
                      display: Mapping[str, str] | None = None) -> Column:
    """Prompt prefix plus ``"A is v, B is w, "`` for the given conditions."""
    display = dict(DISPLAY_NAMES) if display is None else dict(display)
    prefix = record_prefix(year, region)
    if not conditions:
        return prefix
    parts = [F.concat(F.lit(f"{display.get(k, k)} is "), v.cast("string")) for k, v in conditions]
    return F.concat(prefix, F.concat_ws(", ", *parts), F.lit(", "))


def generation_prompt(year: Column, region: Column, conditions: Column, *, display: Mapping[str, str] | None = None,
                      use_era_context: bool = False) -> Column:
    """``generation_prefix`` with region and conditions (a map, in its order) as columns; no conditions, no list."""
    display = dict(DISPLAY_NAMES) if display is None else dict(display)
    names = F.create_map(*[x for k, v in display.items() for x in (F.lit(k), F.lit(v))])
    parts = F.transform(F.map_entries(conditions), lambda e: F.concat(
        F.coalesce(F.try_element_at(names, e["key"]), e["key"]), F.lit(" is "), e["value"]))
    prefix = F.concat(F.lit("In "), year.cast("string"), F.lit(", a resident of "), region, F.lit(" was recorded: "))
    text = F.concat(prefix, F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ", "), F.lit(", "))).otherwise(F.lit("")))
    if not use_era_context:
        return text
    narr = era_narrative_expr(year)
    return F.when(narr.isNotNull() & (narr != ""), F.concat(F.lit(CONTEXT_OPEN), narr, F.lit(CONTEXT_CLOSE), text)).otherwise(text)


# ------------------------------------------------------------------ parsing

def _internal_name(name: Column, display: Mapping[str, str]) -> Column:
    expr = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    for internal, shown in display.items():
        expr = F.when(name == F.lit(shown), F.lit(internal)).otherwise(expr)
    return expr


def parse_pairs(text: Column, display: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """Return ``(prefix_year STRING, pairs ARRAY<STRUCT<k,v>>)`` for a text column."""
    display = dict(DISPLAY_NAMES) if display is None else dict(display)
    t = F.regexp_replace(text, CONTEXT_RE, "")
    starts = t.startswith("In ")
    year_raw = py_strip(F.replace(F.substring_index(t, ",", 1), F.lit("In "), F.lit("")))
    year = F.when(starts, year_raw.try_cast("bigint").cast("string"))
    rec = F.instr(t, "was recorded: ")
    colon = F.instr(t, ": ")
    body = (F.when(starts & (rec > 0), F.substr(t, rec + F.lit(14)))
            .when(starts & (colon > 0), F.substr(t, colon + F.lit(2)))
            .otherwise(t))
    body = F.regexp_replace(body, SECOND_RECORD_RE, "")
    body = F.rtrim(body, F.lit(". \t\n"))
    pieces = F.filter(F.split(body, ", "), lambda p: F.instr(p, " is ") > 0)

    def to_kv(p: Column) -> Column:
        at = F.instr(p, " is ")
        name = py_strip(F.substring_index(p, " is ", 1))
        value = F.rtrim(py_strip(F.substr(p, at + F.lit(4))), F.lit("."))
        return F.struct(_internal_name(name, display).alias("k"), value.alias("v"))

    return year, F.transform(pieces, to_kv)


def first_value(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda kv: kv["k"] == F.lit(key)), 0)["v"]


def stage(df: DataFrame, *cols) -> DataFrame:
    """Evaluate ``cols`` once, in a codegen'd projection, then fence them.

    Catalyst pushes filters through projections by substituting column
    definitions, and collapses projections the same way; with large derived
    expressions (a text parse, fuzzy-match chains) that re-evaluates them
    many times per row.  The computed columns are passed on through a
    one-row generator (``inline(array(struct(col...)))``) holding plain
    column references, which neither rule can see through.
    """
    from pyspark.sql import Column as _C

    projected = df.select(*[c if isinstance(c, _C) else F.col(c) for c in cols])
    return projected.select(F.inline(F.array(F.struct(*[F.col(f"`{n}`") for n in projected.columns]))))


def parse_records(df: DataFrame, text_col: str = "text", attrs: Sequence[str] | None = None,
                  display: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Parse texts into ``(keep..., year STRING, attrs... STRING)``; first wins.

    Two projections: the pair array is computed once, then each field is a
    first-match lookup in it.
    """
    from popweave.domain import CENSUS_ATTRS

    attrs = list(attrs) if attrs else list(CENSUS_ATTRS)
    year, pairs = parse_pairs(F.col(text_col), display)
    staged = stage(df, *keep, year.alias("_year"), pairs.alias("_pairs"))
    return stage(
        staged,
        *keep,
        F.coalesce(F.col("_year"), first_value(F.col("_pairs"), "year")).alias("year"),
        *[first_value(F.col("_pairs"), a).alias(a) for a in attrs],
    )


# ------------------------------------------------------------- fuzzy match

def normalized(value: Column) -> Column:
    """``value.lower().strip()`` — the key every fuzzy rule compares."""
    return py_strip(F.lower(value))


def fuzzy_match(value: Column, cats: Sequence[str], *, prenormalized: Column | None = None) -> Column:
    """Closest category by the three ordered heuristics; null if none.

    (1) case-insensitive equality, (2) value starts with the category,
    (3) category starts with the value and the value has >= 3 characters.
    A literal CASE chain: first hit in domain order wins.
    """
    v = normalized(value) if prenormalized is None else prenormalized
    expr = F.lit(None).cast("string")
    rules = []
    for c in cats:
        rules.append((v == F.lit(c.lower()), c))
    for c in cats:
        rules.append((v.startswith(c.lower()), c))
    for c in cats:
        rules.append(((F.length(v) >= 3) & F.startswith(F.lit(c.lower()), v), c))
    for cond, c in reversed(rules):
        expr = F.when(cond, F.lit(c)).otherwise(expr)
    return expr


def match_category(value: Column, cats: Sequence[str], *, prenormalized: Column | None = None) -> Column:
    """Exact domain value if present, else the fuzzy match (null if none).

    Pass ``prenormalized`` (a staged ``normalized(value)`` column) when the
    value is a derived expression, so the chain compares a plain column.
    """
    return F.when(value.isin(list(cats)), value).otherwise(fuzzy_match(value, cats, prenormalized=prenormalized))
