"""Gates between the steps of a model's making, with all of their rules, and what they read from model files.

Every gate gives rows (subject, rule, level, finding): what stands against going on.  A finding of level ``block`` fails its subject,
one of level ``warn`` only says so; ``statuses`` rolls them up.  No gate has more than one row for a subject and rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatica.operators.fields import KEEP_DESCRIPTION
from prismatica.operators.lineage import cut
from prismatica.sources import modelfiles

#: Lengths of descriptions, the share of covered queries, of changed lines, tokens of a plan, characters of its reasoning.
DESCRIPTION, COVERED, CHANGED, MOST_TOKENS, LEAST_REASONING = (15, 200), 90, 0.5, 800_000, 50
#: What is published beside the model files.
ARTIFACTS = ("metric_catalog.json", "filter_catalog.json", "golden_questions.json", "coverage_report.json")


def _findings(rows: DataFrame, subject: Column, *rules: tuple[str, str, Column, Column]) -> DataFrame:
    """One row for each subject and rule (name, level, when, finding) that holds; a condition that is null doesn't."""
    said = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), finding.cast("string").alias("finding"))) for rule, level, when, finding in rules]
    return rows.select(subject.cast("string").alias("subject"), F.explode(F.array_compact(F.array(*said))).alias("x")).select("subject", "x.*")


def _n(count: Column, what: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {what}"))


def statuses(subjects: DataFrame, findings: DataFrame) -> DataFrame:
    """subject, status (fail, warn or pass), blocking, warnings (numbers of findings): one row for each of ``subjects(subject)``, and for
    any other subject of a finding."""
    rows = subjects.select(F.col("subject").cast("string"), F.lit("").alias("level")).unionByName(findings.select("subject", "level"))
    counted = rows.groupBy("subject").agg(F.count_if(F.col("level") == "block").alias("blocking"), F.count_if(F.col("level") == "warn").alias("warnings"))
    return counted.select("subject", F.when(F.col("blocking") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass").alias("status"), "blocking", "warnings")


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _first_views(found: DataFrame) -> DataFrame:
    """path, view, table, and n_derived of the whole file: its first view is what was made for its table."""
    rows = modelfiles.views(found).select("path", F.struct("number", "view", "table").alias("v"), F.col("derived").isNotNull().alias("derived"))
    return rows.groupBy("path").agg(F.min("v").alias("v"), F.count_if("derived").alias("n_derived")).select("path", "v.view", "v.table", "n_derived")


def enrichment(files: DataFrame, context: DataFrame, wanted: DataFrame, questions: DataFrame) -> DataFrame:
    """What is wrong with the file made for each table; ``files`` has (table, path, text), one file a table.

    ``context`` is that of ``corpus.table_context``, ``wanted`` of ``proposals.propose_explores``, ``questions`` of
    ``proposals.golden_questions``.  A file that can't be read blocks, and nothing else is said of its content.  Joins of its explore
    that don't stand in the order of the queries block.  The rest warns: descriptions that are missing, under 15 or over 200 characters,
    CTEs without any derived table, no primary key, dates as plain dimensions, no sql_table_name, measures without
    value_format_name, no questions, and an explore without always_filter.  Descriptions that are missing count as short, too.
    """
    texts = files.select("path", "text")
    broken = modelfiles.faults(texts).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("fault")), "; ").alias("fault"))
    # Four results read the blocks, and two the subjects.
    found = cut(modelfiles.blocks(texts))
    subject = files.select("table", "path").join(broken, "path", "left")
    asked = questions.groupBy("table").agg(F.count("*").alias("questions"))
    dates = F.array_distinct(F.filter(F.transform("date_parts", lambda d: d["column"]), lambda c: c.isNotNull()))
    subject = subject.join(context.select("table", F.size("ctes").alias("n_ctes"), dates.alias("dates")), "table", "left").join(asked, "table", "left")
    subject = subject.join(wanted.select("table", F.array_distinct(F.transform("joins", lambda j: j["right_table"])).alias("order")), "table", "left")
    subject = cut(subject)
    main = _first_views(found).withColumnRenamed("table", "sql_table")
    explored = modelfiles.explores(found).groupBy("path").agg(F.min_by(F.transform("joins", lambda j: j["view"]), "explore").alias("joined"))
    filtered = found.where((F.col("kind") == "always_filter") & (F.get("above", F.lit(0))["kind"] == "explore")).select("path", F.lit(True).alias("filtered")).distinct()
    whole = subject.where("fault is null").join(main, "path", "left").join(explored, "path", "left").join(filtered, "path", "left")

    own = modelfiles.fields(found).where(F.col("kind").isin("dimension", "dimension_group", "measure"))
    own = own.join(whole.select("path", "view", "dates"), ["path", "view"])
    said = F.length(F.coalesce("description", F.lit("")))
    a_date = F.exists("dates", lambda d: F.contains(F.coalesce("sql", F.lit("")), d))
    counts = own.groupBy("path").agg(
        F.count_if(said == 0).alias("bare"),
        F.count_if(said < DESCRIPTION[0]).alias("short"),
        F.count_if(said > DESCRIPTION[1]).alias("long"),
        F.count_if((F.col("kind") == "dimension") & (F.col("rest")["primary_key"] == "yes")).alias("keys"),
        F.count_if((F.col("kind") == "dimension") & a_date).alias("plain_dates"),
        F.count_if((F.col("kind") == "measure") & F.col("rest")["value_format_name"].isNull()).alias("unformatted"),
    )
    rows = whole.join(counts, "path", "left")
    has_view = F.col("view").isNotNull()
    places = F.filter(F.transform("order", lambda t: F.array_position("joined", t)), lambda p: p > 0)
    out = _findings(
        rows,
        F.col("table"),
        ("join_order", "block", places != F.array_sort(places), F.concat(F.lit("joins should stand in the order "), F.array_join("order", ", "))),
        ("descriptions_missing", "warn", F.col("bare") > 0, _n(F.col("bare"), "fields without description")),
        ("descriptions_short", "warn", F.col("short") > 0, _n(F.col("short"), f"descriptions under {DESCRIPTION[0]} characters")),
        ("descriptions_long", "warn", F.col("long") > 0, _n(F.col("long"), f"descriptions over {DESCRIPTION[1]} characters")),
        ("derived_tables", "warn", (F.col("n_ctes") > 0) & (F.coalesce("n_derived", F.lit(0)) == 0), _n(F.col("n_ctes"), "CTEs and no derived table")),
        ("primary_key", "warn", has_view & (F.coalesce("keys", F.lit(0)) == 0), F.lit("no primary key")),
        ("plain_dates", "warn", F.col("plain_dates") > 0, _n(F.col("plain_dates"), "dates are plain dimensions")),
        ("sql_table_name", "warn", F.col("sql_table").isNull(), F.lit("no sql_table_name")),
        ("value_formats", "warn", F.col("unformatted") > 0, _n(F.col("unformatted"), "measures without value_format_name")),
        ("always_filter", "warn", F.col("joined").isNotNull() & F.col("filtered").isNull(), F.lit("the explore has no always_filter")),
    )
    of_all = _findings(subject, F.col("table"), ("syntax", "block", F.col("fault").isNotNull(), F.col("fault")), ("questions", "warn", F.col("questions").isNull(), F.lit("no questions")))
    return out.unionByName(of_all)


def evaluation(checked: DataFrame, previous: DataFrame | None = None, faults: DataFrame | None = None) -> DataFrame:
    """What a coverage check (``coverage.check``) says against going on.

    Queries that ``previous(query_id, covered)`` had covered and that now aren't (or are gone), and files with ``faults(path, fault)``,
    block.  A share of covered queries under 90 percent, as subject ``corpus``, and queries whose structural filters or joins aren't in
    the model, warn.  Without queries everything is covered.
    """
    lacks = lambda need: F.count_if(~F.col("covered") & (F.col("need") == need)) > 0
    by_query = checked.groupBy("query_id").agg(F.bool_and("covered").alias("covered"), lacks("structural").alias("structural"), lacks("join").alias("joins"))
    share = by_query.agg(F.coalesce(100 * F.count_if("covered") / F.nullif(F.count("*"), F.lit(0)), F.lit(100.0)).alias("share"))
    out = _findings(share, F.lit("corpus"), ("coverage", "warn", F.col("share") < COVERED, F.format_string("%.1f%% of queries are covered", "share")))
    before = by_query.withColumn("lost", F.lit(False))
    if previous is not None:
        had = previous.where("covered").select("query_id").distinct().withColumn("had", F.lit(True))
        before = by_query.join(had, "query_id", "full").withColumn("lost", F.col("had").isNotNull() & ~F.coalesce("covered", F.lit(False)))
    out = out.unionByName(
        _findings(
            before,
            F.col("query_id"),
            ("regression", "block", F.col("lost"), F.lit("was covered before")),
            ("structural_filters", "warn", F.col("structural"), F.lit("structural filters aren't in the model")),
            ("join_paths", "warn", F.col("joins"), F.lit("joins aren't in the model")),
        )
    )
    return out if faults is None else out.unionByName(_unreadable(faults))


def _unreadable(faults: DataFrame) -> DataFrame:
    rows = faults.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("fault")), "; ").alias("fault"))
    return _findings(rows, F.col("path"), ("syntax", "block", F.lit(True), F.col("fault")))


def _lines(text: Column) -> Column:
    """Distinct lines; a line break at the end opens no line, and an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(F.regexp_replace(text, r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value; a null isn't.  The parser stops after the first value, but what follows one can't be both the
    rest of a list and the rest of an object."""
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()
    return inside("[", "]") & inside('{"a":', "}")


def pre_publish(files: DataFrame, baseline: DataFrame, artifacts: DataFrame) -> DataFrame:
    """What stands against publishing model files(path, text) beside the JSON texts of artifacts(name, text).

    Files that can't be read and JSON that isn't any (a null or empty text too) block.  Expected artifacts that are absent warn, and so
    do views of which lines that only one side has are over half of the baseline's lines; baseline(path, text) has the same paths.
    """
    out = _unreadable(modelfiles.faults(files.select("path", "text")))
    views = files.where(F.col("path").endswith(".view.lkml")).select("path", _lines(F.col("text")).alias("now"))
    both = views.join(baseline.select("path", _lines(F.col("text")).alias("was")), "path")
    share = (F.size(F.array_except("was", "now")) + F.size(F.array_except("now", "was"))) / F.nullif(F.size("was"), F.lit(0))
    out = out.unionByName(_findings(both, F.col("path"), ("changed", "warn", share > CHANGED, F.format_string("%.0f%% changed", 100 * share))))
    judged = artifacts.select("name", (~is_json(F.col("text"))).alias("bad"))
    out = out.unionByName(_findings(judged, F.col("name"), ("json", "block", F.col("bad"), F.lit("not JSON"))))
    named = artifacts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ARTIFACTS))).alias("name"))
    return out.unionByName(_findings(named.join(artifacts.select("name"), "name", "left_anti"), F.col("name"), ("artifact", "warn", F.lit(True), F.lit("not there"))))


def planning(plans: DataFrame, context: DataFrame) -> DataFrame:
    """What is wrong with plans(table, dimensions, measures, tokens, reasoning, questions, risks), numbers but for the reasoning.

    ``context`` is that of ``corpus.table_context``.  Tables of it without plan, plans without dimension and measure, and plans of over
    800,000 tokens block.  Reasoning under 50 characters, no questions, and no risks where queries have CTEs or CASEs, warn.
    """
    known = context.select("table", F.size("ctes").alias("ctes"), F.col("n_cases").alias("cases"), F.lit(True).alias("known"))
    rows = known.join(plans.withColumn("planned", F.lit(True)), "table", "full")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    planned = F.col("planned").isNotNull()
    thin = F.length(F.coalesce("reasoning", F.lit("")))
    return _findings(
        rows,
        F.col("table"),
        ("plan", "block", ~planned, F.lit("no plan")),
        ("fields", "block", planned & none("dimensions") & none("measures"), F.lit("no dimension or measure")),
        ("tokens", "block", planned & (F.col("tokens") > MOST_TOKENS), _n(F.col("tokens"), "tokens")),
        ("reasoning", "warn", planned & (thin < LEAST_REASONING), _n(thin, "characters of reasoning")),
        ("questions", "warn", planned & none("questions"), F.lit("no questions")),
        ("risks", "warn", planned & none("risks") & (~none("ctes") | ~none("cases")), F.lit("CTEs or CASEs, and no risks")),
    )


def filter_operators(used: DataFrame, catalog: DataFrame) -> DataFrame:
    """Filters of ``proposals.filter_catalog`` that a catalog(table, column, operators) doesn't foresee: a column that isn't in it warns, an
    operator that its entry doesn't allow blocks.  The subject is table.column; operators count whatever their case, <> as !=."""
    same = lambda o: F.replace(F.upper(F.trim(o)), F.lit("<>"), F.lit("!="))
    entries = catalog.select("table", "column", F.explode_outer("operators").alias("o")).groupBy("table", "column").agg(F.collect_set(same(F.col("o"))).alias("allowed"))
    asked = used.groupBy("table", "column").agg(F.array_sort(F.collect_set(same(F.col("operator")))).alias("operators"))
    rows = asked.join(entries, ["table", "column"], "left")
    denied = F.array_except("operators", "allowed")
    return _findings(
        rows,
        F.concat_ws(".", "table", "column"),
        ("catalog", "warn", F.col("allowed").isNull(), F.lit("not in the catalog")),
        ("operator", "block", F.size(denied) > 0, F.concat(F.lit("not allowed: "), F.array_join(denied, ", "))),
    )


# ---------------------------------------------------------------------------------------------- what files say about quality


def quality_signals(files: DataFrame, dates: DataFrame) -> DataFrame:
    """path and nine counters of the first view of each file that can be read; dates(path, dates) are the columns that queries read as dates.

    A date is plain if no dimension group has it as its name or as a word of its own in its SQL.  Files without views have zeros.
    """
    texts = files.select("path", "text")
    good = texts.join(modelfiles.faults(texts).select("path").distinct(), "path", "left_anti")
    found = cut(modelfiles.blocks(good))
    own = modelfiles.fields(found).join(_first_views(found).select("path", "view"), ["path", "view"])
    dim, measure, group = (F.col("kind") == k for k in ("dimension", "measure", "dimension_group"))
    words = F.filter(F.transform(F.split(F.regexp_replace(F.lower(F.coalesce("sql", F.lit(""))), r"\$\{table\}\.", ""), r"\s+"), lambda w: F.regexp_replace(w, r"^[;`,()]+|[;`,()]+$", "")), lambda w: w.rlike(r"^[a-z_]\w*$"))
    short = ~_blank("description") & (F.length(F.trim("description")) < KEEP_DESCRIPTION)
    counts = own.groupBy("path").agg(
        F.count_if(dim).alias("dims_total"),
        F.count_if(dim & _blank("description")).alias("dims_missing_description"),
        F.count_if(dim & short).alias("dims_short_description"),
        F.count_if(dim & _blank("label")).alias("dims_missing_label"),
        F.count_if(dim & (F.size("tags") == 0)).alias("dims_missing_tags"),
        F.count_if(measure).alias("measures_total"),
        F.count_if(measure & F.col("rest")["value_format"].isNull() & F.col("rest")["value_format_name"].isNull()).alias("measures_missing_value_format"),
        F.max(dim & F.lower(F.coalesce(F.col("rest")["primary_key"], F.lit(""))).isin("yes", "true")).alias("has_primary_key"),
        F.flatten(F.collect_list(F.when(group, F.concat(words, F.array(F.lower("name")))))).alias("grouped"),
    )
    nothing = F.array().cast("array<string>")
    rows = good.select("path").join(counts, "path", "left").join(dates.select("path", F.transform("dates", F.lower).alias("dates")), "path", "left")
    plain = F.size(F.array_except(F.coalesce("dates", nothing), F.coalesce("grouped", nothing)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    totals = [c for c in counts.columns if c not in ("path", "has_primary_key", "grouped")]
    return rows.select("path", *map(zero, totals), F.when(F.col("dims_total").isNotNull(), plain).otherwise(0).cast("bigint").alias("dates_as_plain_dim"), F.coalesce("has_primary_key", F.lit(False)).alias("has_primary_key"))


def metric_catalog(found: DataFrame) -> DataFrame:
    """metric (view.name), path, type, label, description, value_format, sql: measures of ``modelfiles.fields``, the first by path and
    position where a view has several of one name."""
    form = F.regexp_replace(F.coalesce(F.col("rest")["value_format"], F.col("rest")["value_format_name"]), '^"(.*)"$', "$1")
    said = F.struct("path", "position", "type", "label", "description", form.alias("value_format"), "sql")
    rows = found.where("kind = 'measure'").groupBy("view", "name").agg(F.min(said).alias("m"))
    return rows.select(F.concat_ws(".", "view", "name").alias("metric"), "m.path", "m.type", "m.label", "m.description", "m.value_format", "m.sql")
