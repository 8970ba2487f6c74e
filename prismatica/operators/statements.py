"""Structural facets of SQL statements, from their tokens.

A corpus (query_id, prompt, sql) keeps its rows: a text becomes the array of its tokens, and a fold over them gives every token its
nesting, its scope (the subquery it stands in), its clause and its CASE; literals and comments are single tokens, so words inside them
never count.  The facets are expressions on that array.  Nothing is shuffled, and a task holds one statement at a time, never a corpus.

Known limits: predicates are comparisons with a column, or a function's first column, on the left; OR counts as AND, and NOT before a
bracket negates each predicate inside; a parenthesised join condition gives no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismatica.functions import sqltext as S

TOKEN = (
    r"(?s)--[^\n]*|/\*.*?\*/|'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\""
    r"|\w+(?:-\w+)+\.\w+\.\w+|(?:`[^`]+`|[A-Za-z_]\w*)(?:\.(?:`[^`]+`|\w+|\*))*"
    r"|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|<>|!=|>=|<=|\|\||::|\S"
)
#: Words that are never names, those that open a clause, comparisons, and set operators.
KEYWORDS = (
    "SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT QUALIFY WINDOW UNION INTERSECT EXCEPT ALL DISTINCT JOIN LEFT RIGHT FULL INNER CROSS OUTER ON "
    "USING AS AND OR NOT IN BETWEEN IS NULL LIKE CASE WHEN THEN ELSE END WITH RECURSIVE CREATE REPLACE TEMP TEMPORARY TABLE IF EXISTS OVER "
    "PARTITION ASC DESC TRUE FALSE INTERVAL OFFSET SET DECLARE BEGIN CALL"
).split()
CLAUSES = ("SELECT", "FROM", "JOIN", "ON", "USING", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "QUALIFY", "WINDOW", "UNION", "INTERSECT", "EXCEPT")
COMPARISONS = ("=", "!=", "<>", ">", ">=", "<", "<=", "IN", "BETWEEN", "IS", "LIKE")
STARTS = ("SELECT", "WITH", "CREATE")
#: Tokens that change where those after them stand.
MARKS = ("(", ")", ",", "CASE", "END", *CLAUSES)
#: Tokens that are gathered before they join those of the blocks before.
BLOCK = 64


#: A token: its place from 1, its bracket's ends and whether that holds a query, its scope, clause, item, and CASE.
KIND = "struct<i:int,token:string,up:string,name:string,calls:boolean,open:int,close:int,asks:boolean,scope:int,base:boolean,clause:string,item:int,case_at:int>"


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _but_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.size(a) - 1)


def _chosen(words: Column) -> Column:
    """The words of the first statement that reads or creates a table, without semicolons, and the depth of brackets before it.

    Statements before it (DECLARE, SET, CALL) are left out; where none starts so, the words count from the first SELECT or WITH on.
    """
    bend = lambda x: F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
    first = lambda holds: F.array_min(F.transform(words, lambda x, k: F.when(holds(x, k), k)))
    opens = lambda k: F.coalesce(F.get(words, k - 1), F.lit(";")) == ";"
    start = F.coalesce(first(lambda x, k: opens(k) & F.upper(x).isin(*STARTS)), first(lambda x, k: F.upper(x).isin("SELECT", "WITH")), F.size(words))

    def within(at: Column) -> Column:
        depth = F.aggregate(F.slice(words, F.lit(1), at), F.lit(0), lambda d, x: d + bend(x))
        rest = F.slice(words, at + 1, F.size(words))

        def step(s: Column, x: Column) -> Column:
            over = s["over"] | ((x == ";") & (s["depth"] == 0))
            return F.struct((s["depth"] + bend(x)).alias("depth"), over.alias("over"), (s["n"] + F.when(over, 0).otherwise(1)).alias("n"))

        many = F.aggregate(rest, F.struct(depth.alias("depth"), F.lit(False).alias("over"), F.lit(0).alias("n")), step, lambda s: s["n"])
        return F.struct(depth.alias("depth"), F.filter(F.slice(rest, F.lit(1), many), lambda x: x != ";").alias("words"))

    return S.bound(start, within)


def _read(words: Column, depth: Column) -> Column:
    """Tokens of a statement's words, by one fold with stacks of the open brackets, scopes and CASEs.

    Only brackets, commas, CASEs and words that open a clause (``MARKS``) move the stacks; other tokens just read them.
    """
    scopes = "array<struct<at:int,depth:int,clause:string,item:int>>"
    none = F.array().cast(f"array<{KIND}>")
    stacks = F.struct(
        F.lit(0).alias("i"),
        depth.alias("depth"),
        F.lit(0).alias("cases"),
        F.array().cast("array<struct<at:int,asks:boolean>>").alias("brackets"),
        F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("clause"), F.lit(0).alias("item"))).cast(scopes).alias("scopes"),
        F.array().cast("array<int>").alias("case_at"),
        none.alias("read"),
    )

    def step(s: Column, token: Column) -> Column:
        # Appending copies an array, so tokens are gathered by blocks.
        block, full = F.concat(s["block"], s["now"]["read"]), F.size(s["block"]) >= BLOCK
        return F.struct(after(s["now"], token).alias("now"), F.when(full, s["now"]["read"]).otherwise(block).alias("block"), F.when(full, F.concat(s["t"], F.array(s["block"]))).otherwise(s["t"]).alias("t"))

    def after(s: Column, token: Column) -> Column:
        return S.bound(F.upper(token), lambda up: told(s, token, up))

    def told(s: Column, token: Column, up: Column) -> Column:
        i = s["i"] + 1
        plain = token.rlike(r"^(?:[A-Za-z_`]|\w+-\w)") & ~up.isin(*KEYWORDS)
        name = F.when(plain, F.substring_index(F.replace(token, F.lit("`"), F.lit("")), ".", -1))
        asks = F.coalesce(F.upper(F.get(words, i)).isin("SELECT", "WITH"), F.lit(False))
        # A parenthesis belongs to what it encloses, and an END to its CASE.
        brackets = F.when(token == "(", F.concat(s["brackets"], F.array(F.struct(i.alias("at"), asks.alias("asks"))))).otherwise(s["brackets"])
        x = F.struct(i.alias("i"), token.alias("token"), up.alias("up"), name.alias("name"), (s["depth"] + F.when(token == "(", 1).otherwise(0)).alias("depth"), (s["cases"] + F.when(up == "CASE", 1).otherwise(0)).alias("cases"), brackets.alias("brackets"))
        marked = lambda x: S.bound(placed(s, x), lambda y: S.bound(counted(x, y), lambda z: moved(s, x, y, z)))
        return S.bound(x, lambda x: F.when(x["up"].isin(*MARKS), marked(x)).otherwise(passed(s, x)))

    def passed(s: Column, x: Column) -> Column:
        """The state after a token that moves no stack."""
        top, scope = _last(s["brackets"]), _last(s["scopes"])
        read = reading(x, top, scope, x["depth"] == scope["depth"], _last(s["case_at"]))
        return F.struct(x["i"].alias("i"), *[s[c].alias(c) for c in ("depth", "cases", "brackets", "scopes", "case_at")], F.array(read).alias("read"))

    def reading(x: Column, top: Column, scope: Column, base: Column, case_at: Column) -> Column:
        calls = x["name"].isNotNull() & F.coalesce(F.get(words, x["i"]) == "(", F.lit(False))
        told = {"open": top["at"], "close": F.lit(None).cast("int"), "asks": top["asks"], "scope": scope["at"], "base": base, "clause": scope["clause"], "item": scope["item"], "case_at": F.when(x["cases"] > 0, case_at)}
        return F.struct(*[x[c].alias(c) for c in ("i", "token", "up", "name")], calls.alias("calls"), *[v.alias(c) for c, v in told.items()])

    def placed(s: Column, x: Column) -> Column:
        top = _last(x["brackets"])
        asks = F.coalesce(top["asks"], F.lit(False))
        scope = F.struct(x["i"].alias("at"), x["depth"].alias("depth"), F.lit(None).cast("string").alias("clause"), F.lit(0).alias("item"))
        scopes = F.when((x["token"] == "(") & asks, F.concat(s["scopes"], F.array(scope))).otherwise(s["scopes"])
        cases = F.when((x["up"] == "CASE") & (x["cases"] > 0), F.concat(s["case_at"], F.array(x["i"]))).otherwise(s["case_at"])
        return F.struct(top.alias("top"), ((x["token"] == ")") & asks).alias("leaves"), scopes.alias("scopes"), cases.alias("cases"))

    def counted(x: Column, y: Column) -> Column:
        scope = _last(y["scopes"])
        base = (x["depth"] == scope["depth"]) & ~(x["token"].isin("(", ")") & F.coalesce(y["top"]["asks"], F.lit(True)))
        clause = base & x["up"].isin(*CLAUSES)
        return F.struct(scope["at"].alias("at"), scope["depth"].alias("depth"), base.alias("base"), F.when(clause, x["up"]).otherwise(scope["clause"]).alias("clause"), (scope["item"] + F.when(clause | (base & (x["token"] == ",")), 1).otherwise(0)).alias("item"))

    def moved(s: Column, x: Column, y: Column, z: Column) -> Column:
        read = reading(x, y["top"], z, z["base"], _last(y["cases"]))
        scope = F.struct(*[z[c].alias(c) for c in ("at", "depth", "clause", "item")])
        closes = x["token"] == ")"
        ends = x["up"] == "END"
        return F.struct(
            x["i"].alias("i"),
            (x["depth"] - F.when(closes, 1).otherwise(0)).alias("depth"),
            (x["cases"] - F.when(ends, 1).otherwise(0)).alias("cases"),
            F.when(closes & y["top"].isNotNull(), _but_last(x["brackets"])).otherwise(x["brackets"]).alias("brackets"),
            F.when(y["leaves"], _but_last(y["scopes"])).when(z["base"], F.concat(_but_last(y["scopes"]), F.array(scope))).otherwise(y["scopes"]).alias("scopes"),
            F.when(ends & (x["cases"] > 0), _but_last(y["cases"])).otherwise(y["cases"]).alias("case_at"),
            F.array(read).alias("read"),
        )

    def closed(t: Column) -> Column:
        """Brackets with the place of what closes them."""
        ends = F.filter(t, lambda y: (y["token"] == ")") & y["open"].isNotNull())
        close = lambda ends, x: F.when(x["token"] == "(", F.get(F.filter(ends, lambda y: y["open"] == x["i"]), F.lit(0))["i"])
        return S.bound(ends, lambda ends: F.transform(t, lambda x: x.withField("close", close(ends, x))))

    return F.aggregate(words, F.struct(stacks.alias("now"), none.alias("block"), F.array().cast(f"array<array<{KIND}>>").alias("t")), step, lambda s: closed(F.concat(F.flatten(s["t"]), s["block"], s["now"]["read"])))


def tokens(sql: Column) -> Column:
    """Array of the tokens of a text's first statement that reads or creates a table, without comments; a null text has none."""
    text = F.regexp_replace(S.cleaned(sql), "^\\ufeff", "")
    words = F.filter(F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>")), lambda x: ~x.rlike(S.COMMENT))
    return S.bound(words, lambda w: S.bound(_chosen(w), lambda c: _read(c["words"], c["depth"])))


def _near(t: Column, x: Column, by: int) -> Column:
    """The token ``by`` places after x."""
    return F.get(t, x["i"] - 1 + by)


def _text(t: Column, first: Column, last: Column) -> Column:
    """Tokens first..last as written, one space between them."""
    return F.array_join(F.transform(F.slice(t, first, F.greatest(last - first + 1, F.lit(0))), lambda x: x["token"]), " ")


def _operand(t: Column, o: Column) -> Column:
    """The operand that starts at token o, as text, and its last token: a call, a bracket, a typed or negative literal, or one token."""
    pair = ~o["calls"] & o["up"].isin("-", "DATE", "TIMESTAMP", "DATETIME", "TIME", "NUMERIC", "INTERVAL")
    last = F.when(o["calls"], _near(t, o, 1)["close"]).when(o["token"] == "(", o["close"]).when(pair, o["i"] + 1).otherwise(o["i"])
    text = F.when(o["up"] == "-", F.concat(o["token"], _near(t, o, 1)["token"])).otherwise(_text(t, o["i"], last))
    return F.struct(text.alias("text"), last.alias("last"))


def _alias(t: Column, x: Column) -> Column:
    """The alias of the select item that x stands in: after AS, or a name that follows the end of an expression."""
    item = F.filter(t, lambda y: (y["scope"] == x["scope"]) & (y["item"] == x["item"]) & y["base"] & (y["i"] > x["i"]))
    named = F.filter(item, lambda y: y["up"] == "AS")
    last = F.get(item, F.size(item) - 1)
    before = _near(t, last, -1)
    bare = last["name"].isNotNull() & ~last["calls"] & (before["i"] >= x["i"]) & ((before["token"] == ")") | (before["up"] == "END") | before["name"].isNotNull() | before["token"].rlike(r"^[\d'\"]"))
    return F.when(x["clause"] == "SELECT", F.coalesce(_near(t, F.get(named, F.lit(0)), 1)["name"], F.when((F.size(named) == 0) & bare, last["name"])))


def _ctes(t: Column) -> Column:
    listed = lambda x: _near(t, x, -2)["token"] == ")"  # noqa: E731  names of its columns stand between
    named = lambda x: F.when(listed(x), F.get(t, _near(t, x, -2)["open"] - 2)).otherwise(_near(t, x, -2))
    opens = lambda x: (x["token"] == "(") & (x["asks"] | (x["close"] == x["i"] + 1))
    found = F.filter(t, lambda x: opens(x) & (_near(t, x, -1)["up"] == "AS") & named(x)["name"].isNotNull() & _near(t, named(x), -1)["up"].isin("WITH", "RECURSIVE", ","))
    return F.transform(found, lambda x: F.struct(named(x)["name"].alias("alias"), _text(t, x["i"] + 1, x["close"] - 1).alias("body"), x["i"].alias("from"), x["close"].alias("to")))


def _created(t: Column) -> Column:
    found = F.filter(t, lambda x: x["name"].isNotNull() & (_near(t, x, 1)["up"] == "AS") & _near(t, x, -1)["up"].isin("TABLE", "EXISTS") & (F.get(t, F.lit(0))["up"] == "CREATE") & (x["i"] < 10))
    head = lambda x, *words: F.exists(F.slice(t, F.lit(1), x["i"]), lambda y: y["up"].isin(*words))
    return F.transform(found, lambda x: F.struct(x["name"].alias("alias"), _text(t, x["i"] + 2, F.size(t)).alias("body"), head(x, "TEMP", "TEMPORARY").alias("is_temp"), head(x, "REPLACE").alias("is_replace")))


def _table_tokens(t: Column) -> Column:
    return F.filter(t, lambda x: x["name"].isNotNull() & ~x["calls"] & x["base"] & x["clause"].isin("FROM", "JOIN") & _near(t, x, -1)["up"].isin("FROM", "JOIN", ","))


def _aggregations(t: Column) -> Column:
    found = F.filter(t, lambda x: x["calls"] & F.lower(x["name"]).isin(*S.AGGREGATES))

    def read(x: Column) -> Column:
        distinct = F.coalesce(_near(t, x, 2)["up"] == "DISTINCT", F.lit(False))
        at = x["i"] + F.when(distinct, 3).otherwise(2)
        argument = F.get(t, at - 1)
        return F.struct(F.upper(x["name"]).alias("function"), F.when(((_near(t, x, 1)["close"] == at + 1) | (distinct & (F.get(t, at)["token"] == ","))) & ~argument["calls"], argument["name"]).alias("column"), distinct.alias("distinct"), _alias(t, x).alias("alias"))

    return F.transform(found, read)


def _cases(t: Column) -> Column:
    def read(x: Column) -> Column:
        return S.bound(F.filter(t, lambda y: (y["case_at"] == x["i"]) & y["up"].isin("WHEN", "THEN", "ELSE", "END")), lambda marks: told(x, marks))

    def told(x: Column, marks: Column) -> Column:
        branches = F.filter(F.transform(marks, lambda m, k: F.struct(m["up"].alias("up"), m["i"].alias("when"), F.get(marks, k + 1)["i"].alias("then"), F.get(marks, k + 2)["i"].alias("until"))), lambda b: b["up"] == "WHEN")
        texts = F.transform(branches, lambda b: F.struct(_text(t, b["when"] + 1, b["then"] - 1).alias("when"), F.regexp_replace(_text(t, b["then"] + 1, b["until"] - 1), r"^'(.*)'$", "$1").alias("then")))
        inside = F.filter(t, lambda y: (y["i"] > x["i"]) & (y["i"] < F.get(marks, F.size(marks) - 1)["i"]) & y["name"].isNotNull() & ~y["calls"])
        return F.struct(_alias(t, x).alias("alias"), F.get(inside, F.lit(0))["name"].alias("column"), texts.alias("branches"), _text(t, x["i"], F.get(marks, F.size(marks) - 1)["i"]).alias("sql"))

    return F.transform(F.filter(t, lambda x: x["up"] == "CASE"), read)


def _joins(t: Column) -> Column:
    found = F.filter(t, lambda x: x["base"] & (x["up"] == "JOIN"))

    def read(x: Column, n: Column) -> Column:
        on = F.get(F.filter(t, lambda y: (y["scope"] == x["scope"]) & (y["item"] == x["item"] + 1) & (y["up"] == "ON") & y["base"]), F.lit(0))
        return S.bound(on, lambda on: told(x, n, on))

    def told(x: Column, n: Column, on: Column) -> Column:
        side = F.when(_near(t, x, -1)["up"] == "OUTER", _near(t, x, -2)["up"]).otherwise(_near(t, x, -1)["up"])
        kind = F.when(side.isin("LEFT", "RIGHT", "FULL", "CROSS"), F.lower(side)).otherwise("inner")
        ended = F.coalesce(_near(t, on, 4)["token"] == ")", F.lit(True)) | (_near(t, on, 4)["item"] != on["item"]) | _near(t, on, 4)["up"].isin("LEFT", "RIGHT", "FULL", "INNER", "CROSS")
        single = (_near(t, on, 2)["token"] == "=") & _near(t, on, 1)["name"].isNotNull() & _near(t, on, 3)["name"].isNotNull() & ended
        key = lambda k: F.when(single, _near(t, on, k)["name"])
        qualifier = F.when(single, F.nullif(F.regexp_extract(F.regexp_replace(_near(t, on, 1)["token"], "`", ""), r"^(?:.*\.)?(\w[\w-]*)\.\w+$", 1), F.lit("")))
        return F.struct((n + 1).alias("position"), kind.alias("kind"), qualifier.alias("left_table"), F.when(_near(t, x, 1)["up"] == "LATERAL", F.when(_near(t, x, 2)["token"] != "(", _near(t, x, 2)["name"])).otherwise(_near(t, x, 1)["name"]).alias("table"), key(1).alias("left_key"), key(3).alias("right_key"), (x["scope"] == 0).alias("main"))

    return F.transform(found, read)


def _predicates(t: Column) -> Column:
    found = F.filter(t, lambda x: (x["clause"] == "WHERE") & x["up"].isin(*COMPARISONS) & x["case_at"].isNull())

    def read(x: Column) -> Column:
        turned = F.coalesce(_near(t, x, -1)["up"] == "NOT", F.lit(False))
        left = F.when(turned, _near(t, x, -2)).otherwise(_near(t, x, -1))
        inside = F.filter(t, lambda y: (y["i"] > left["open"]) & (y["i"] < left["i"]) & y["name"].isNotNull() & ~y["calls"] & (F.coalesce(_near(t, y, 1)["up"], F.lit("")) != "FROM"))
        peeled = F.when((left["token"] == ")") & F.get(t, left["open"] - 2)["calls"], F.get(inside, F.lit(0))["name"])
        before = _near(t, left, -1)["up"] == "NOT"
        low = _operand(t, _near(t, x, 1))
        opened, is_not = _near(t, x, 1), F.coalesce(_near(t, x, 1)["up"] == "NOT", F.lit(False))
        items = F.transform(F.filter(F.slice(t, opened["i"] + 1, F.greatest(F.coalesce(opened["close"] - opened["i"] - 1, F.lit(0)), F.lit(0))), lambda y: y["token"] != ","), lambda y: y["token"])
        value = (
            F.when(x["up"] == "IN", F.when(opened["asks"], F.lit("(subquery)")).otherwise(F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))))
            .when(x["up"] == "BETWEEN", F.concat_ws(" AND ", low["text"], _operand(t, F.get(t, low["last"] + 1))["text"]))
            .when(x["up"] == "IS", F.lit("NULL"))
            .when(opened["calls"], _text(t, opened["i"], _near(t, opened, 1)["close"]))
            .when(opened["up"].isin("-", "DATE", "TIMESTAMP", "INTERVAL"), F.concat(opened["token"], F.when(opened["up"] == "-", F.lit("")).otherwise(F.lit(" ")), _near(t, x, 2)["token"]))
            .otherwise(opened["token"])
        )
        operator = F.when(x["up"] == "<>", F.lit("!=")).otherwise(x["up"])
        denied = F.size(F.filter(t, lambda y: (y["token"] == "(") & (y["i"] < x["i"]) & (y["close"] > x["i"]) & (y["scope"] == x["scope"]) & F.coalesce(_near(t, y, -1)["up"] == "NOT", F.lit(False)))) % 2 == 1
        return F.struct(F.coalesce(left["name"], peeled).alias("column"), operator.alias("operator"), value.alias("value"), ((turned | (F.coalesce(before, F.lit(False))) | ((x["up"] == "IS") & is_not)) != denied).alias("negated"), x["scope"].alias("scope"))

    return F.filter(F.transform(found, read), lambda p: p["column"].isNotNull())


def _dimensions(t: Column) -> Column:
    ends = lambda x: F.coalesce((_near(t, x, 1)["token"] == ",") | (_near(t, x, 1)["token"] == ")") | _near(t, x, 1)["up"].isin(*CLAUSES), F.lit(True))
    bare = F.filter(t, lambda x: x["name"].isNotNull() & ~x["calls"] & x["base"] & ends(x) & (((x["clause"] == "SELECT") & _near(t, x, -1)["up"].isin("SELECT", "DISTINCT", ",")) | ((x["clause"] == "GROUP") & _near(t, x, -1)["up"].isin("BY", ","))))
    return F.array_distinct(F.filter(F.transform(bare, lambda x: x["name"]), lambda n: n != "*"))


def _dates(t: Column) -> Column:
    found = F.filter(t, lambda x: x["calls"] & F.upper(x["name"]).isin("EXTRACT", "DATE_TRUNC", "DATE"))

    def read(x: Column) -> Column:
        kind, a, b = F.upper(x["name"]), _near(t, x, 2), _near(t, x, 4)
        unit = lambda y: F.upper(F.regexp_replace(y["token"], "'", ""))
        reversed_ = a["token"].startswith("'")
        column = F.when(kind == "EXTRACT", F.when(_near(t, x, 3)["up"] == "FROM", b["name"])).when(kind == "DATE", F.when(_near(t, x, 1)["close"] == x["i"] + 3, a["name"])).when(reversed_, b["name"]).otherwise(a["name"])
        function = F.when(kind == "EXTRACT", a["up"]).when(kind == "DATE", F.lit("DATE")).when(reversed_, unit(a)).otherwise(unit(b))
        return F.struct(column.alias("column"), function.alias("function"))

    return F.array_distinct(F.filter(F.transform(found, read), lambda d: d["column"].isNotNull()))


def statements(corpus: DataFrame) -> DataFrame:
    """Every query with its facets, errors as data: parse_error is null, empty_input, not_a_query, or what ``sqltext.fault`` finds.

    tables (in the order in which they are first named, without CTEs and created tables), ctes (alias, body, sources, filters), created,
    aggregations, cases, joins, predicates (scope 0: the outermost query), equality_filters, dimensions, date_parts, has_window.  Each
    row is read by itself, whatever its query_id.  A null text is empty.
    """
    # Texts alone are dealt out, by a number that isn't lowered: few bytes take long to read.
    texts = corpus.select("query_id", "prompt", "sql").repartition(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")
    # Generated, so that the tokens are made once for each row and no filter on facets makes them again.
    rows = texts.select("*", F.explode(F.array(tokens(F.col("sql")))).alias("t"))
    t = F.col("t")
    error = F.when(F.coalesce(S.normalised(F.col("sql")), F.lit("")).isin("", "''", '""', "``"), "empty_input").when(~F.exists(t, lambda x: x["up"] == "SELECT"), "not_a_query").when(F.size(t) > 0, S.fault(F.transform(t, lambda x: x["token"])))
    rows = rows.select("query_id", "prompt", _text(t, F.lit(1), F.size(t)).alias("statement"), error.alias("parse_error"), "t")
    rows = rows.select("*", _ctes(t).alias("c"), _created(t).alias("created"), _table_tokens(t).alias("named"), _predicates(t).alias("predicates"))
    within = lambda c: F.transform(F.filter("named", lambda n: (n["i"] > c["from"]) & (n["i"] < c["to"])), lambda n: n["name"])
    aliases = F.transform("c", lambda c: c["alias"])
    ctes = F.transform("c", lambda c: F.struct(c["alias"].alias("alias"), c["body"].alias("body"), F.array_except(F.array_distinct(within(c)), aliases).alias("sources"), F.array_intersect(F.array_distinct(within(c)), aliases).alias("upstream"), F.filter("predicates", lambda p: p["scope"] == c["from"]).alias("filters")))
    tables = F.array_except(F.array_distinct(F.transform("named", lambda n: n["name"])), F.concat(aliases, F.transform("created", lambda c: c["alias"])))
    equal = F.filter("predicates", lambda p: (p["operator"] == "=") & ~p["negated"] & p["value"].rlike(r"^(?:'.*'|-?\d+(?:\.\d+)?)$"))
    rows = rows.select("query_id", "prompt", "statement", "parse_error", tables.alias("tables"), F.get(tables, F.lit(0)).alias("primary_table"), ctes.alias("ctes"), "created", _aggregations(t).alias("aggregations"), _cases(t).alias("cases"), _joins(t).alias("joins"), "predicates", F.transform(equal, lambda p: F.struct(p["column"].alias("column"), p["value"].alias("value"))).alias("equality_filters"), _dimensions(t).alias("dimensions"), _dates(t).alias("date_parts"), F.exists(t, lambda x: x["up"] == "OVER").alias("has_window"))
    structure = (
        F.when(F.col("parse_error").isNotNull(), "unknown")
        .when((F.size("ctes") > 0) | F.col("has_window") | (F.size("joins") >= 2), "complex")
        .when((F.size("joins") >= 1) | (F.size("aggregations") >= 2) | (F.size("cases") > 0), "medium")
        .otherwise("simple")
    )
    ready = (F.size("tables") > 0) & ((F.size("dimensions") > 0) | (F.size("aggregations") > 0))
    return rows.withColumn("complexity", structure).withColumn("ready", ready)
