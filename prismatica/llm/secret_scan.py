"""Secret scans with DataFrame functions only.

Base patterns give spans per text.  Multipart linking then joins identifiers, secrets and endpoints that lie within one scope of each
other, on (text, bin of one scope's width): a weak candidate is reported only where a complementary part co-occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatica.llm.common import checkpoint, names_apart

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: 20 characters with the four fixed ones; a shorter run holds no later match that is long enough.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))

#: Weak candidates, reported only next to a complementary part: kind, role, pattern.
WEAK = (
    ("weak_id", "identifier", r"(?<![A-Za-z0-9])A(?:SIA|ROA|IDA|GPA)[A-Z0-9]{12,124}(?![A-Za-z0-9])"),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    ("endpoint", "endpoint", r"https?://[A-Za-z0-9.-]{4,253}(?::[0-9]{1,5})?"),
)
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: r for k, r, _ in WEAK}
#: Roles whose presence in scope completes a weak candidate of a role.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier",), "endpoint": ("identifier", "secret")}
SPANS = "array<struct<start:int,end:int,rank:int,kind:string,kept:boolean>>"
#: Width of a scope in code points.
SCOPE = 400
BLOCK = 64


def _running(lengths: Column) -> Column:
    """Sum of all earlier elements, for each element: by blocks, so that thousands of matches in one text stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))))
    return F.transform(
        lengths,
        lambda _, i: total(F.slice(blocks, F.lit(1), F.floor(i / BLOCK).cast("int"))) + total(F.slice(lengths, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK)),
    )


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, end, rank, kind>> of the matches; positions in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    rank = [k for k, _ in BASE].index(kind) if kind in dict(BASE) else len(BASE) + [k for k, *_ in WEAK].index(kind)
    pieces = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), *([F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v")] if kind == "assign" else []))
    starts = _running(F.transform(pieces, lambda p: F.length(p["m"]) + p["g"]))
    spans = F.zip_with(
        pieces,
        starts,
        lambda p, s: F.struct(
            (s + p["g"]).alias("start"),
            (s + p["g"] + F.length(p["m"])).alias("end"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (F.length(p["v"]) >= 6 if kind == "assign" else F.lit(True)).alias("kept"),
        ),
    )
    return F.filter(spans, lambda x: x["kept"])


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _found(docs: DataFrame, text: str, keep: list[str], scope: int, told_by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with __text and __key, and (__key, kept columns, base, weak, counts) of the same rows without texts.

    Rows are told apart by all their plain columns and their text; equal rows share one key and one result.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    plain = [c for c in (keep if told_by is None else told_by) if docs.schema[c].dataType.typeName() not in ("array", "map", "struct", "variant")]
    rows = docs.withColumn("__text", whole)
    rows = rows.withColumn("__key", F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in plain], F.col("__text")), 256))
    empty = F.array().cast(SPANS)
    spans = rows
    for kind, pattern in (*BASE, *((k, p) for k, _, p in WEAK)):
        spans = spans.withColumn(f"__{kind}", F.when(F.col("__text").rlike(pattern), _spans(F.col("__text"), kind, pattern).cast(SPANS)).otherwise(empty))
    base = F.concat(*[F.col(f"__{k}") for k, _ in BASE])
    weak = F.concat(*[F.col(f"__{k}") for k, *_ in WEAK])
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k, _ in BASE]
    found = checkpoint(spans.select(*[F.col(f"`{c}`") for c in keep], "__key", base.alias("base"), weak.alias("__weak"), *counts))
    linked = link(found.where(F.size("__weak") > 0).select("__key", F.explode(F.array_distinct(F.concat("base", "__weak"))).alias("part")), scope)
    return rows, found.join(linked, "__key", "left").drop("__weak").withColumn("weak", F.coalesce("weak", empty))


@names_apart(replaced=("base", "weak", "n_assign", "n_access", "n_hex"))
def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Every row without its text but with base (array of spans), weak (array of reported weak spans) and n_assign, n_access, n_hex.

    A null text counts as empty and has no spans.  Repeated rows each get the same spans.  Spans of different kinds may overlap;
    those of one kind don't.  Columns named as the results are replaced.  One pass over the texts; only rows of found parts are
    shuffled, by text and bin, and pre-aggregated to one row for each bin before they meet.
    """
    results = ("base", "weak", "n_assign", "n_access", "n_hex")
    return _found(docs, text, [c for c in docs.columns if c not in (text, *results)], scope)[1].drop("__key")


@names_apart("n_chars")
def redact(docs: DataFrame, mask: str, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Every row with all spans of ``scan`` replaced by ``mask`` in its text, overlapping ones by one; a column n_chars counts anew.

    Rows without spans, null texts included, stay as they are.
    """
    rows, found = _found(docs, text, [], scope, told_by=[c for c in docs.columns if c != text])
    hits = found.select("__key", F.array_sort(F.concat("base", "weak")).alias("__spans")).where(F.size("__spans") > 0).dropDuplicates(["__key"])
    at = lambda start, end: F.substring(F.col("__text"), start + 1, end - start)
    step = lambda acc, s: F.when(s["end"] <= acc["pos"], acc).otherwise(
        F.struct(s["end"].alias("pos"), F.when(s["start"] >= acc["pos"], F.concat(acc["out"], at(acc["pos"], s["start"]), F.lit(mask))).otherwise(acc["out"]).alias("out")).cast("struct<pos:int,out:string>")
    )
    blank = F.aggregate("__spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")).cast("struct<pos:int,out:string>"), step, lambda acc: F.concat(acc["out"], at(acc["pos"], F.length("__text"))))
    out = rows.join(hits, "__key", "left").withColumn(text, F.when(F.col("__spans").isNull(), F.col(f"`{text}`")).otherwise(blank))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def link(parts: DataFrame, scope: int) -> DataFrame:
    """From (__key, part) the weak parts with a complementary part that starts within ``scope`` code points: (__key, weak array).

    An interval join on bins of width ``scope``: a part in the same bin is in scope; of the bins beside it, the last start below and
    the first start above decide, so each bin is one pre-aggregated row for each role.
    """
    role = F.create_map(*[F.lit(x) for k, r in ROLES.items() for x in (k, r)])
    parts = parts.select("__key", "part", role[F.col("part.kind")].alias("role"), F.floor(F.col("part.start") / scope).alias("bin")).distinct()
    bins = parts.groupBy("__key", "role", "bin").agg(F.min("part.start").alias("first"), F.max("part.start").alias("last"))
    near = bins.select("__key", "role", F.explode(F.array(F.col("bin") - 1, "bin", F.col("bin") + 1)).alias("bin"), F.col("bin").alias("own"), "first", "last")
    wanted = F.create_map(*[x for r, c in COMPLEMENTS.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    weak = parts.where(F.col("part.kind").isin([k for k, *_ in WEAK])).select("__key", "part", "bin", F.explode(wanted[F.col("role")]).alias("role"))
    hit = weak.join(near, ["__key", "role", "bin"]).where(
        (F.col("own") == F.col("bin")) | ((F.col("own") < F.col("bin")) & (F.col("part.start") - F.col("last") <= scope)) | ((F.col("own") > F.col("bin")) & (F.col("first") - F.col("part.start") <= scope))
    )
    return hit.select("__key", "part").distinct().groupBy("__key").agg(F.collect_list("part").alias("weak"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and all spans as text, for every document."""
    out = scan(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "weak")).alias("spans"))
