"""Model files (.lkml) as rows: blocks, views, fields and explores; and rows as texts again, written as whole views.

A file is read in its own row: one pass over its tokens keeps the open blocks as a stack, so every attribute knows its key path.  Nothing
is shuffled or sorted for it, the pass takes time by the length of the text, and a worker holds one file's tokens at a time.  Values that
end with ``;;`` are single tokens, so whatever stands in them (braces, quotes, comments) never opens or closes a block.  SQL in
values is kept as text.  Broken files are rows of ``faults``; what can be read of them is still read.
"""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels of blocks that are kept apart; deeper ones belong to the last of these.
LEVELS = 6
#: Kinds of fields, and the attributes that have columns of their own.
FIELD_KINDS = ("dimension", "measure", "dimension_group", "filter", "parameter")
OWN = ("type", "sql", "label", "description", "tags")
#: Keys whose values end with two semicolons.
_LONG = r"(?:sql\w*|html|expression\w*)"
TOKEN = (
    r"(?s)#[^\n]*"
    rf"|{_LONG}\s*:(?!\s*\{{)[^;]*+(?:;(?!;)[^;]*+)*+;;"
    r'|"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    r"|[A-Za-z_][\w.+-]*\s*:"
    r"|[{}\[\],]"
    r'|[^\s{}\[\],#":;]+|\S'
)
ATTRIBUTE = "array<struct<at:int,key:string,form:string,items:array<string>>>"


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), text: one row for each .lkml file at any depth."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.lkml").text(folder, wholetext=True)
    named = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    below = F.substring_index(named, f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return files.select(below.alias("path"), F.col("value").alias("text"))


# Workers get the functions themselves, so they needn't have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Characters of texts whose rows make one Arrow batch.
BATCH = 2_000_000
_TOKEN, _KEY, _LONG_HEAD = (re.compile(p, re.ASCII) for p in (TOKEN, r"[\w.+-]+", rf"{_LONG}\s*:\s*"))
_SPACES = " \t\n\v\f\r"
_MARKS = frozenset("{}[],")


def _tokens(text: str) -> tuple[Sequence[int], list[str]]:
    """The places and texts of a file's tokens, without comments."""
    found = _TOKEN.findall(text)
    if "#" not in text:
        return range(len(found)), found
    at = [i for i, x in enumerate(found) if x[0] != "#"]
    return at, found if len(at) == len(found) else [found[i] for i in at]


def _is_key(x: str) -> bool:
    return x[-1:] == ":" and len(x) > 1


def _is_long(x: str) -> bool:
    return x[-2:] == ";;"


def _is_value(x: str) -> bool:
    return x != "" and x not in _MARKS and not _is_key(x) and not _is_long(x)


def _heads(key: int, t: list[str]) -> bool:
    """Whether a key is the head of a block; two empty tokens stand behind the last one."""
    return t[key + 1] == "{" or (t[key + 2] == "{" and _is_value(t[key + 1]))


def _attribute(at: int, t: list[str]) -> tuple[int, str, str, list[str]]:
    first = t[0]
    if _is_long(first):
        return at, _KEY.match(first).group(), "long", [first[_LONG_HEAD.match(first).end() : -2].rstrip(_SPACES).strip(" ")]
    key = first[:-1].rstrip(_SPACES)
    if len(t) == 1:
        return at, key, "none", []
    if t[1] == "[":
        inside = " ".join("\1" if x == "," else x for x in t[1:] if x not in ("[", "]"))
        return at, key, "list", [x for x in re.split(" ?\1 ?", inside) if x]
    return at, key, "text" if t[1][0] == '"' else "word", [t[1]]


def _read(text: str) -> list[tuple]:
    """A text's blocks: at, kind, name, above, attributes, inner, as ``blocks`` says."""
    at, t = _tokens(text)
    n = len(t)
    t = [*t, "", ""]
    out = [(-1, None, None, [], [], [])]
    stack: list[tuple] = [None] * LEVELS  # the newest block of each level, and where it begins
    depth = listed = first = 0
    own = out[0]

    def end(i: int) -> None:
        """Ends the part that began at ``first``: an attribute, if it begins with a key."""
        if first < i and t[first][-1] in ":;" and (_is_key(t[first]) or _is_long(t[first])):
            own[4].append(_attribute(at[first], t[first:i]))

    def leave(level: int, i: int) -> None:
        """Ends a block before token i and puts its text under the one around it."""
        (child, begins), (around, _) = stack[level - 1], stack[level - 2]
        head = None if child[1] is None else f"{child[1]}: " + ("" if child[2] is None else f"{child[2]} ")
        around[5].append((child[0], None if head is None else head + " ".join(t[begins:i])))

    for i in range(n):
        x = t[i]
        last = x[-1]
        if last == ":":
            if len(x) == 1:
                continue
            if _heads(i, t):
                end(i)
                first = i + 1
            elif listed == 0:
                end(i)
                first = i
        elif last == ";":
            if listed == 0 and _is_long(x):
                end(i)
                first = i
        elif x not in _MARKS:
            continue
        elif x == "{":
            end(i)
            depth += 1
            if 1 <= depth <= LEVELS:
                named = i > 0 and _is_value(t[i - 1])
                before = t[i - 1 - named] if i > named else None
                kind = before[:-1].rstrip(_SPACES) if before is not None and before[-1] == ":" else before
                own = (at[i], kind, t[i - 1] if named else None, [b[:3] for b, _ in stack[: depth - 1]], [], [])
                stack[depth - 1] = (own, i)
                out.append(own)
            first = i + 1
        elif x == "}":
            end(i)
            if 2 <= depth <= LEVELS:
                leave(depth, i + 1)
            depth -= 1
            own = stack[min(depth, LEVELS) - 1][0] if depth > 0 else out[0]
            first = i + 1
        elif x == "[":
            listed += 1
        elif x == "]":
            listed -= 1
    end(n)
    for level in range(min(depth, LEVELS), 1, -1):
        leave(level, n)
    return out


def _faults(text: str) -> list[str]:
    """Why a text can't be read whole, as ``faults`` says."""
    _, t = _tokens(text)
    n = len(t)
    t = [*t, "", ""]
    depth = listed = opened = endless = quotes = bare = 0
    under = False
    for i in range(n):
        x = t[i]
        if x[-1] == ":":
            if len(x) > 1 and not _heads(i, t):
                after = t[i + 1]
                endless += listed == 0 and _LONG_HEAD.fullmatch(x) is not None
                bare += after in ("", "}", "]", ",") or _is_key(after) or _is_long(after)
        elif x == '"':
            quotes += 1
        elif x not in _MARKS:
            continue
        elif x == "{":
            opened += 1
            depth += 1
        elif x == "}":
            under = under or depth < 1
            depth -= 1
        elif x == "[":
            listed += 1
        elif x == "]":
            listed -= 1
    told = (
        (depth > 0, "a block isn't closed"),
        (depth < 0 or under, "a block is closed too often"),
        (endless > 0 or quotes > 0, "a value doesn't end"),
        (bare > endless, "a key has no value"),
        (opened == 0, "no block"),
    )
    return [what for when, what in told if when]


def _structs(lists: list[list[tuple]], **columns: pa.DataType) -> pa.Array:
    """Lists of tuples as an array of lists of structs."""
    flat = list(chain.from_iterable(lists))
    values = list(zip(*flat, strict=True)) or [()] * len(columns)
    fields = [pa.array(v, k) for v, k in zip(values, columns.values(), strict=True)]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), pa.StructArray.from_arrays(fields, names=list(columns)))


def _by_file(read, columns, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``read`` finds in each text, with its path, a bounded number of texts' characters at a time."""
    collects = gc.isenabled()
    gc.disable()  # it would walk through all that was read, and nothing here holds a cycle
    try:
        for batch in batches:
            path, texts = batch.column(0), batch.column(1)
            of: list[int] = []
            rows: list = []
            size = 0
            for i in range(batch.num_rows):
                text = (texts[i].as_py() or b"").decode("utf-8", "replace")
                found = read(text)
                rows += found
                of += [i] * len(found)
                size += len(text)
                if size >= BATCH or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_pydict({"path": path.take(pa.array(of, pa.int32())), **columns(rows)})
                    of, rows, size = [], [], 0
    finally:
        if collects:
            gc.enable()


def _files(files: DataFrame) -> DataFrame:
    # As bytes: a text that isn't UTF-8 is read like any other.
    return files.select("path", F.col("text").cast("string").cast("binary").alias("text"))


def _unquoted(text: Column) -> Column:
    return F.when(text.rlike('(?s)^".*"$'), F.replace(F.regexp_extract(text, '(?s)^"(.*)"$', 1), F.lit('\\"'), F.lit('"'))).otherwise(text)


def blocks(files: DataFrame) -> DataFrame:
    """path, at, kind, name, above (array of at, kind, name: its key path, outermost first), attributes, inner: one row for each block.

    ``at`` orders the blocks of a file.  ``attributes`` are in order: key, form (long, text, word, list or none), and the value as
    written, or the list's items.  ``inner`` are the blocks directly inside, as (at, text).  A file's own attributes are those of a
    block without kind, at -1.  Rows with equal paths are files of their own.
    """
    text, texts, whole = pa.string(), pa.list_(pa.string()), pa.int32()

    def columns(rows: list[tuple]) -> dict[str, pa.Array]:
        at, kind, name, above, attributes, inner = zip(*rows, strict=True) if rows else ((),) * 6
        return {
            "at": pa.array(at, whole),
            "kind": pa.array(kind, text),
            "name": pa.array(name, text),
            "above": _structs(above, at=whole, kind=text, name=text),
            "attributes": _structs(attributes, at=whole, key=text, form=text, items=texts),
            "inner": _structs(inner, at=whole, text=text),
        }

    shape = f"at int, kind string, name string, above array<struct<at:int,kind:string,name:string>>, attributes {ATTRIBUTE}, inner array<struct<at:int,text:string>>"
    given = _files(files)
    return given.mapInArrow(lambda batches: _by_file(_read, columns, batches), f"path {given.schema['path'].dataType.simpleString()}, {shape}")


def _no_entries() -> Column:
    return F.create_map().cast("map<string,string>")


def _value(key: str) -> Column:
    """An attribute's last value, unquoted; null if there is none or it is empty."""
    found = F.filter("attributes", lambda a: (a["key"] == key) & (F.size(a["items"]) > 0))
    return F.nullif(_unquoted(F.get(F.get(found, F.size(found) - 1)["items"], F.lit(0))), F.lit(""))


def faults(files: DataFrame) -> DataFrame:
    """path, fault: why a file can't be read whole.

    Blocks that aren't closed, or closed too often; values without end (a key whose value should end with ``;;``, a quote that isn't
    closed); keys without value; files that hold no block.
    """
    given = _files(files)
    return given.mapInArrow(lambda batches: _by_file(_faults, lambda rows: {"fault": pa.array(rows, pa.string())}, batches), f"path {given.schema['path'].dataType.simpleString()}, fault string")


def _other(*known: str) -> Column:
    """The attributes that aren't known, as written; of repeated keys the last one counts."""
    other = F.filter("attributes", lambda a: ~a["key"].isin(*known) & (a["form"] != "none"))
    last = F.filter(other, lambda a: ~F.exists(other, lambda b: (b["key"] == a["key"]) & (b["at"] > a["at"])))
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"], _written(a))))


def _named(name: Column) -> Column:
    """A view's name, or else its file's."""
    return F.coalesce(name, F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.view)?\.lkml$", ""))


def views(found: DataFrame) -> DataFrame:
    """path, number, view, table, derived, label, description, rest, derived_rest, inner, at: one row for each view of ``blocks``.

    ``number`` counts a file's views from 1; callers that read one view a file take the first.  ``rest`` and ``derived_rest`` are the
    other attributes of the view and of its derived table, ``inner`` its blocks that aren't fields, all as written.
    """
    top = found.where("kind = 'view' and size(above) = 0")
    number = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    derived = found.where("kind = 'derived_table' and size(above) = 1").select("path", F.get("above", F.lit(0))["at"].alias("at"), F.struct(F.col("at").alias("place"), _value("sql").alias("sql"), F.to_json(_other("sql")).alias("rest")).alias("d"))
    derived = derived.groupBy("path", "at").agg(F.min("d").alias("d"))
    inner = F.transform(F.filter("inner", lambda x: ~F.regexp_extract(x["text"], r"^(\w+):", 1).isin("derived_table", *FIELD_KINDS)), lambda x: x["text"])
    rows = top.select("path", "at", number.alias("number"), _named(F.col("name")).alias("view"), _value("sql_table_name").alias("table"), _value("label").alias("label"), _value("description").alias("description"), _other("sql_table_name", "label", "description").alias("rest"), inner.alias("inner"))
    rest = F.coalesce(F.from_json("d.rest", "map<string,string>"), _no_entries())
    return rows.join(derived, ["path", "at"], "left").select("path", "number", "view", "table", F.col("d.sql").alias("derived"), "label", "description", "rest", rest.alias("derived_rest"), "inner", "at")


def fields(found: DataFrame) -> DataFrame:
    """path, view, position, kind, name, type, sql, label, description, tags, rest (other attributes as written), inner (blocks as written).

    One row for each named dimension, measure, dimension group, filter and parameter; ``position`` orders a file's fields.
    """
    around = F.get("above", F.lit(0))
    rows = found.where(F.col("kind").isin(*FIELD_KINDS) & (F.size("above") == 1) & F.col("name").isNotNull() & (around["kind"] == "view"))
    tags = F.filter("attributes", lambda a: a["key"] == "tags")
    tags = F.transform(F.coalesce(F.get(tags, F.size(tags) - 1)["items"], F.array().cast("array<string>")), _unquoted)
    return rows.select("path", _named(around["name"]).alias("view"), F.col("at").alias("position"), "kind", "name", *[_value(c).alias(c) for c in OWN[:-1]], tags.alias("tags"), _other(*OWN).alias("rest"), F.transform("inner", lambda x: x["text"]).alias("inner"))


def explores(found: DataFrame) -> DataFrame:
    """path, explore, base, always_where, joins (position, view, type, relationship, sql_on; in their order), as ``coverage`` reads them."""
    top = found.where("kind = 'explore' and size(above) = 0").select("path", "at", F.col("name").alias("explore"), F.coalesce(_value("from"), _value("view_name"), F.col("name")).alias("base"), _value("sql_always_where").alias("always_where"))
    joins = found.where("kind = 'join' and size(above) = 1").select("path", F.get("above", F.lit(0))["at"].alias("at"), F.struct(F.col("at").alias("position"), F.coalesce(_value("from"), F.col("name")).alias("view"), _value("type").alias("type"), _value("relationship").alias("relationship"), _value("sql_on").alias("sql_on")).alias("j"))
    joins = joins.groupBy("path", "at").agg(F.array_sort(F.collect_list("j")).alias("joins"))
    return top.join(joins, ["path", "at"], "left").select("path", "explore", "base", "always_where", F.coalesce("joins", F.array().cast(joins.schema["joins"].dataType)).alias("joins"))


# ---------------------------------------------------------------------------------------------- rows as texts


def _written(attribute: Column) -> Column:
    """An attribute's value as it stands in a file."""
    one = F.get(attribute["items"], F.lit(0))
    return F.when(attribute["form"] == "list", F.concat(F.lit("["), F.array_join(attribute["items"], ", "), F.lit("]"))).when(attribute["form"] == "long", F.concat(one, F.lit(" ;;"))).otherwise(one)


def _quote(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _lines(indent: str, *pairs: tuple[str, Column]) -> Column:
    """Lines ``key: value`` of the values that are there, each with its line break."""
    return F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{indent}{k}: "), v, F.lit("\n"))) for k, v in pairs])), "")


def field_text() -> Column:
    """A field's block as text."""
    sql = F.when(F.coalesce("sql", F.lit("")) != "", F.concat("sql", F.lit(" ;;")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("["), F.array_join(F.transform("tags", _quote), ", "), F.lit("]")))
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", _quote(F.col(c)))
    own = _lines("    ", ("label", given("label")), ("description", given("description")), ("type", F.col("type")), ("sql", sql), ("tags", tags))
    rest = _entries("    ", F.coalesce("rest", _no_entries()))
    inner = F.array_join(F.transform(F.coalesce("inner", F.array().cast("array<string>")), lambda x: F.concat(F.lit("    "), x, F.lit("\n"))), "")
    return F.concat(F.lit("  "), "kind", F.lit(": "), "name", F.lit(" {\n"), own, rest, inner, F.lit("  }\n"))


def _entries(indent: str, entries: Column) -> Column:
    """Lines of attributes as written, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(F.lit(indent), e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")


def texts(view_rows: DataFrame, field_rows: DataFrame) -> DataFrame:
    """path, text: one file for each path of ``views``, its views by number, their fields by position.

    Every view is one ordered aggregation of its fields' texts, and every file one of its views'; a file is one row.
    """
    body = field_rows.select("path", "view", "position", field_text().alias("text")).groupBy("path", "view").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "").alias("body"))
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    rest = lambda c: F.coalesce(F.col(c), _no_entries())
    has_derived = given("derived").isNotNull() | (F.size(rest("derived_rest")) > 0)
    derived = F.concat(F.lit("{\n"), _lines("    ", ("sql", F.concat(given("derived"), F.lit(" ;;")))), _entries("    ", rest("derived_rest")), F.lit("  }"))
    head = _lines("  ", ("label", _quote(given("label"))), ("description", _quote(given("description"))), ("sql_table_name", F.concat(given("table"), F.lit(" ;;"))), ("derived_table", F.when(has_derived, derived)))
    inner = F.array_join(F.transform(F.coalesce("inner", F.array().cast("array<string>")), lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), "")
    text = F.concat(F.lit("view: "), "view", F.lit(" {\n"), head, _entries("  ", rest("rest")), inner, F.coalesce("body", F.lit("")), F.lit("}\n"))
    rows = view_rows.join(body, ["path", "view"], "left").select("path", "number", text.alias("text"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda x: x["text"]), "\n").alias("text"))


def publish_texts(found: DataFrame, folder: str) -> DataFrame:
    """Writes ``found(path, text)``, and returns what changed: path, action (added, replaced, kept), was, now (SHA-256 of the texts).

    Each path is a partition of ``folder/texts``, one text file, so it is replaced whole or not at all; others stay, and equal ones aren't
    written again.  Spark stages new partitions beside the old ones and moves them when all are written: a run that fails leaves the old
    files.  The ledger in ``folder/ledger`` gets one row for each path that a run added or replaced, after the texts.
    """
    spark, folder = found.sparkSession, folder.rstrip("/")
    now = found.select("path", "text", F.sha2("text", 256).alias("now"))
    old = published(spark, folder).select("path", F.sha2("text", 256).alias("was"))
    action = F.when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "replaced").otherwise("kept")
    rows = now.join(old, "path", "left").select("path", "text", action.alias("action"), "was", "now")
    # The comparison is with the files as they are now, so it is written before they change.
    rows.write.mode("overwrite").parquet(f"{folder}/staged")
    staged = spark.read.schema(rows.schema).parquet(f"{folder}/staged")
    staged.where("action <> 'kept'").select("text", "path").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("path").text(f"{folder}/texts")
    changes = staged.select("path", "action", "was", "now")
    changes.where("action <> 'kept'").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/ledger")
    return changes


def published(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of all that has been published; no rows before the first run."""
    try:
        rows = spark.read.schema("value string, path string").text(f"{folder.rstrip('/')}/texts", wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, text string")
    return rows.select("path", F.expr("left(value, length(value) - 1)").alias("text"))  # without the writer's last line break
