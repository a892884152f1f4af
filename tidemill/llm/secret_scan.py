"""Secret scanning with multipart credential linking, in DataFrame functions only.

Three base patterns are reported wherever they match. Weaker candidates (account identifiers, short or unnamed
secrets, endpoints) are reported only where complementary parts lie in one scope. All spans are code points,
end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.runtime import table, whole_rows

# Fixed patterns of the base kinds. The lengths are part of the pattern where that matches the same spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS = 12

# Patterns of the weaker parts.
IDENT = r"""(?i)\b(client_id|account_id|user_?name|user|login|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
BARE = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""https?://[^\s"'<>]{4,}"""
WEAK_CHARS = 6

#: Farthest distance between parts of one credential.
SCOPE = 300
KINDS = ["assign", "access", "hex", "ident", "weak", "endpoint"]
BASE = KINDS[:3]
BLOCK = 256
FAR = 1 << 40


def running(values: str, join: str, zero: int) -> str:
    """SQL for the running totals of an array column of longs. ``join`` combines {a} and {b} and is associative; it runs in
    blocks, so that a long array costs little more than its length."""
    start = f"CAST({zero} AS BIGINT)"
    grow = "(acc, x) -> concat(acc, array({}))".format(join.format(a=f"coalesce(get(acc, size(acc) - 1), {start})", b="x"))
    none = "CAST(array() AS ARRAY<BIGINT>)"
    starts = f"IF(size({values}) > 0, sequence(0, CAST(floor((size({values}) - 1) / {BLOCK}) AS INT)), CAST(array() AS ARRAY<INT>))"
    blocks = f"transform({starts}, k -> aggregate(slice({values}, k * {BLOCK} + 1, {BLOCK}), {none}, {grow}))"
    ends = f"aggregate(transform(bs, t -> element_at(t, -1)), {none}, {grow})"
    whole = join.format(a=f"IF(k = 0, {start}, get(s.e, k - 1))", b="x")
    # one struct, so that the blocks and their running ends are made once
    return f"""flatten(flatten(transform(transform(array({blocks}), bs -> named_struct('b', bs, 'e', {ends})),
        s -> transform(s.b, (t, k) -> transform(t, x -> {whole})))))"""


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row_`` (all columns of ``docs``), ``spans_``: array of (start, rank, end), ordered, rank a place in KINDS, and
    ``credentials_``: array of the places in ``spans_`` of an identifier, its secret and, if there is one, its endpoint.

    Narrow, whole texts, no Python. Parts are linked by an interval join inside the row, done as a sweep: all parts in order of their
    start, with the running largest end of what lies before and smallest start of what follows for each kind, tell in
    linear time whether a complementary part is within SCOPE code points. A weak secret needs an identifier, an
    identifier needs a secret, an endpoint needs both. Weak parts that overlap a base span are dropped. Each named or weak
    secret then makes one credential with the identifier next to it in SCOPE (the one before or the one after it, whichever
    gap is smaller, the one before if they are equal) and the endpoint next to it likewise. A null or empty text has none.
    """
    df = whole_rows(docs).withColumn("text_", F.coalesce(F.col(f"row_.`{text_col}`"), F.lit("")))
    text = F.col("text_")
    # pattern, and a cheaper test that every text with a match passes
    scans = {
        "assign": (ASSIGN, text.rlike("(?i)password|passwd|secret|token|api_?key")),
        "access": (ACCESS, text.contains("AKIA")),
        "hex": (HEX, text.rlike(HEX)),
        "ident": (IDENT, text.rlike("(?i)_id|user|login")),
        "bare": (BARE, text.rlike("[A-Za-z0-9+/]{32}")),
        "endpoint": (ENDPOINT, text.contains("://")),
    }
    none = F.array().cast("array<string>")
    matches = {f"{n}_found_": F.when(guard, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for n, (p, guard) in scans.items()}
    gaps = {f"{n}_gaps_": F.when(F.size(f"{n}_found_") > 0, F.split(text, p, -1)).otherwise(none) for n, (p, _) in scans.items()}
    gaps["assign_values_"] = F.when(F.size("assign_found_") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(none)
    steps = {f"{n}_steps_": F.expr(f"transform({n}_found_, (m, i) -> CAST(length(get({n}_gaps_, i)) + length(m) AS BIGINT))") for n in scans}
    ends = {f"{n}_ends_": F.expr(running(f"{n}_steps_", "{a} + {b}", 0)) for n in scans}
    df = df.withColumns(matches).withColumns(gaps).withColumns(steps).withColumns(ends)
    value = "length(get(assign_values_, i))"
    ranks = {"assign": f"CASE WHEN {value} >= {ASSIGN_CHARS} THEN 0 WHEN {value} >= {WEAK_CHARS} THEN 4 END", "access": 1, "hex": 2, "ident": 3, "bare": 4, "endpoint": 5}
    spans = ", ".join(
        f"filter(transform({n}_found_, (m, i) -> named_struct('start', get({n}_ends_, i) - length(m), 'rank', CAST({r} AS INT), 'end', get({n}_ends_, i))), p -> p.rank IS NOT NULL)"
        for n, r in ranks.items()
    )
    return _linked(df.select("row_", F.expr(f"array_sort(concat({spans}))").alias("parts_"))).select("row_", "spans_", "credentials_")


def _linked(df: DataFrame) -> DataFrame:
    """``spans_``: the base spans of ``parts_``, and the weaker ones whose complements are near."""
    kinds = {"base": "0, 1, 2", "ident": "1, 3", "secret": "0, 4"}
    weak = "exists(parts_, p -> p.rank > 2)"
    none = "CAST(array() AS ARRAY<BIGINT>)"
    reach = {}
    for name, among in kinds.items():
        reach[f"{name}_end_"] = F.expr(f"IF({weak}, transform(parts_, p -> IF(p.rank IN ({among}), p.end, -{FAR})), {none})")
        reach[f"{name}_start_"] = F.expr(f"IF({weak}, transform(reverse(parts_), p -> IF(p.rank IN ({among}), p.start, {FAR})), {none})")
    joined = {f"{n}_end_": F.expr(running(f"{n}_end_", "greatest({a}, {b})", -FAR)) for n in kinds}
    joined |= {f"{n}_start_": F.expr(f"reverse({running(f'{n}_start_', 'least({a}, {b})', FAR)})") for n in kinds}
    near = lambda n, scope: f"(get({n}_end_, i) > p.start - {scope} OR get({n}_start_, i) < p.end + {scope})"
    ident, secret = near("ident", SCOPE), near("secret", SCOPE)
    needed = f"CASE p.rank WHEN 4 THEN {ident} WHEN 3 THEN {secret} ELSE {ident} AND {secret} END"
    kept = f"IF({weak}, filter(parts_, (p, i) -> p.rank <= 2 OR ({needed} AND NOT {near('base', 0)})), parts_)"
    return _credentials(df.withColumns(reach).withColumns(joined).withColumn("spans_", F.expr(kept)))


def _credentials(df: DataFrame) -> DataFrame:
    """``credentials_`` of ``spans_``, by the running place of the last part of a kind before each span, and of the first after it."""
    kinds = {"ident": "1, 3", "endpoint": "5"}
    both = "(exists(spans_, p -> p.rank IN (0, 4)) AND exists(spans_, p -> p.rank IN (1, 3)))"
    none = "CAST(array() AS ARRAY<BIGINT>)"
    places = {}
    for name, among in kinds.items():
        places[f"{name}_before_"] = F.expr(f"IF({both}, transform(spans_, (p, i) -> IF(p.rank IN ({among}), CAST(i AS BIGINT), -1)), {none})")
        places[f"{name}_after_"] = F.expr(f"IF({both}, reverse(transform(spans_, (p, i) -> IF(p.rank IN ({among}), CAST(i AS BIGINT), {FAR}))), {none})")
    swept = {f"{n}_before_": F.expr(running(f"{n}_before_", "greatest({a}, {b})", -1)) for n in kinds}
    swept |= {f"{n}_after_": F.expr(f"reverse({running(f'{n}_after_', 'least({a}, {b})', FAR)})") for n in kinds}

    def nearest(name: str) -> str:
        before, after = f"get({name}_before_, i)", f"get({name}_after_, i)"
        gap_before = f"IF({before} >= 0, greatest(p.start - get(spans_, CAST({before} AS INT)).end, 0), {FAR})"
        gap_after = f"IF({after} < {FAR}, greatest(get(spans_, CAST({after} AS INT)).start - p.end, 0), {FAR})"
        return f"CASE WHEN least({gap_before}, {gap_after}) >= {SCOPE} THEN NULL WHEN {gap_before} <= {gap_after} THEN {before} ELSE {after} END"

    one = f"IF(p.rank IN (0, 4), named_struct('ident', {nearest('ident')}, 'secret', CAST(i AS BIGINT), 'endpoint', {nearest('endpoint')}), NULL)"
    made = f"IF({both}, filter(transform(spans_, (p, i) -> {one}), c -> c.ident IS NOT NULL), array())"
    return df.withColumns(places).withColumns(swept).withColumn("credentials_", F.expr(made))


def _named(span: Column) -> Column:
    return F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), span["rank"]), span["start"].cast("string"), span["end"].cast("string"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, _named), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: counts of base spans, digest of the base spans, all spans as text, and the credentials as text (the spans
    of one joined by ``+``).

    Null and empty texts have no spans (empty strings, the digest of an empty text); repeated rows are reported
    each; an empty table gives no rows; other columns are ignored.
    """
    found = find_secrets(docs.select(F.col(id_col), F.col(text_col)), text_col)
    count = lambda rank: F.size(F.filter("spans_", lambda s: s["rank"] == rank)).cast("long")
    base = F.filter("spans_", lambda s: s["rank"] <= 2)
    return found.select(
        F.col(f"row_.`{id_col}`").alias(id_col),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans_")).alias("spans"),
        F.array_join(
            F.transform(
                "credentials_", lambda c: F.array_join(F.transform(F.array_compact(F.array(c["ident"], c["secret"], c["endpoint"])), lambda i: _named(F.get("spans_", i.cast("int")))), "+")
            ),
            ",",
        ).alias("credentials"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span of a text replaced by ``[secret]`` (overlapping spans by one mark).

    Other rows keep their text; a column n_chars, if there is one, follows the new text.
    """
    found = find_secrets(docs, text_col)
    text = F.col(f"row_.`{text_col}`")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("[secret]"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    hit = F.size("spans_") > 0
    changed = found.withColumn("clean_", F.when(hit, F.aggregate("spans_", start, step, finish)).otherwise(text))
    new = {text_col: F.col("clean_")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("clean_").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row_.n_chars"))
    return changed.select(*[new.get(c, F.col(f"row_.`{c}`")).alias(c) for c in docs.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
