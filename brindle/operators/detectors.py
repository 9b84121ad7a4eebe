"""Detectors over the tokens of PHP sources (see ``brindle.sources.php.tokens``), as DataFrame plans.

Tokens carry their neighbours and what is open around them, which the lexer leaves with them, so what lies within a
file is a filter or an aggregate; only what files know of each other is joined. Every detector gives findings: rule, severity, confidence, path,
line, message and fingerprint. Tokens carry no types, so names decide where a type would.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.text import matches_glob
from brindle.operators.architecture import family_sizes
from brindle.operators.graphs import crosses_boundary, vote
from brindle.operators.structure import drift_pairs
from brindle.session import checkpoint_dir, written
from brindle.sources.php import LONG, NAMES, NO_CALLS, sorts

# Vocabularies that the detectors look names up in.
BROAD_TYPES = ["Throwable", "Exception", "Error", "RuntimeException"]
# Calls that end a query, that build one, and that write.
TERMINALS = [
    "get", "first", "firstOrFail", "find", "findOrFail", "findMany", "sole", "value", "count", "exists", "doesntExist", "sum", "avg", "average", "min", "max",
    "pluck", "paginate", "simplePaginate", "cursorPaginate", "cursor", "chunk", "firstWhere", "firstOr", "toBase",
]
BUILDERS = [
    "where", "whereIn", "whereNotIn", "whereNull", "whereNotNull", "whereHas", "whereDoesntHave", "orWhere", "query", "newQuery", "select", "join", "leftJoin",
    "orderBy", "groupBy", "having", "limit", "take", "skip", "offset", "with", "withCount", "withSum", "has",
]
WRITES = [
    "save", "saveOrFail", "create", "createMany", "forceCreate", "update", "updateOrCreate", "firstOrCreate", "firstOrNew", "insert", "insertGetId", "insertOrIgnore",
    "upsert", "delete", "forceDelete", "destroy", "restore", "truncate", "increment", "decrement", "attach", "detach", "sync", "associate", "push",
]
QUERIES = [*TERMINALS, *BUILDERS, *WRITES]
# Names that are no models.
NO_MODELS = [
    "App", "Artisan", "Auth", "Blade", "Broadcast", "Bus", "Cache", "Concurrency", "Config", "Context", "Cookie", "Crypt", "Date", "DB", "Event", "Exceptions", "File", "Gate",
    "Hash", "Http", "Lang", "Log", "Mail", "Notification", "Number", "Password", "Process", "Queue", "RateLimiter", "Redirect", "Redis", "Request", "Response", "Route",
    "Schedule", "Schema", "Session", "Storage", "Str", "URL", "Validator", "View", "Vite", "Arr", "Collection", "Pipeline", "Facade", "self", "static", "parent", "Carbon", "Blueprint",
]
MUTATING_ACTIONS = ["store", "update", "destroy", "delete", "remove"]
MUTATING_WORDS = ["delete", "destroy", "remove", "purge", "erase"]
# Words of remarks that stand for code that is not there.
KEPT, LEFT = ["existing", "rest", "remaining", "other", "previous", "same", "unchanged"], ["rest", "remainder"]
DEMANDS, PLACED = ["add", "insert", "put", "write", "place"], ["logic", "code", "implementation"]
HELD, GOING = [*PLACED, "method", "function", "body"], PLACED
PENDING = ["todo", "fixme", "tbd"]
LONGEST_REMARK = 8


def context(tokens: DataFrame) -> DataFrame:
    """Tokens without comments; the lexer has left their neighbours and what is open around them with each."""
    return tokens.where(~F.col("sort").isin(sorts("comment")))


def _of(t: DataFrame, *names: str) -> DataFrame:
    """Tokens of some sorts."""
    return t.where(F.col("sort").isin(sorts(*names)))


def _finding(rows: DataFrame, rule: str, severity, confidence, message: Column, fingerprint: Column, line: str = "line") -> DataFrame:
    grade = severity if isinstance(severity, Column) else F.lit(severity)
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return rows.select(F.lit(rule).alias("rule"), grade.alias("severity"), sure.cast("int").alias("confidence"), "path", F.col(line).cast("long").alias("line"), message.alias("message"), fingerprint.alias("fingerprint"))


def _owner(unit: str = "unit") -> Column:
    return F.concat_ws("::", "class_name", unit)


def fact(make):
    """Facts that several detectors ask of the same tokens: within ``detect`` they are written once."""

    @wraps(make)
    def get(t: DataFrame, *a, **b) -> DataFrame:
        made = getattr(t, "_facts", None)
        if made is None or a or b:
            return make(t, *a, **b)
        if make.__name__ not in made:
            made[make.__name__] = written(make(t))
        return made[make.__name__]

    return get


# --- facts ------------------------------------------------------------------------------------------


@fact
def functions(t: DataFrame) -> DataFrame:
    """Named functions and methods: where they begin, and their visibility."""
    words = [F.lower(f"b{k}") for k in (1, 2, 3)]
    seen = lambda w: reduce(lambda a, b: a | b, [x == w for x in words])
    visibility = F.when(seen("private"), "private").when(seen("protected"), "protected").otherwise("public")
    named = _of(t, "word").where((F.lower("text") == "function") & F.col("a1").rlike(r"^\w+$") & (F.col("a2") == "(") & ~F.col("b1").isin("->", "::", "use"))
    return named.select("path", F.col("n").alias("from"), "line", "class_name", F.col("a1").alias("name"), visibility.alias("visibility"), seen("]").alias("attributed"))


@fact
def parameters(t: DataFrame) -> DataFrame:
    """(path, from, name, type, promoted, visibility): the parameters of all functions; a parameter is what lies between
    two commas of the list."""
    variable = F.col("sort").isin(sorts("variable"))
    rows = _of(t, "variable", "word").where("params_of IS NOT NULL").select("path", F.col("params_of").alias("from"), "arg", "arg_depth", "text", "b1", "b2", variable.alias("variable"))
    word = lambda w: F.max((F.lower("text") == w).cast("int")).over(Window.partitionBy("path", "from", "arg")) == 1
    shown = F.when(word("private"), "private").when(word("protected"), "protected").when(word("public") | word("readonly"), "public")
    named = rows.withColumn("visibility", shown).where(F.col("variable") & (F.col("arg_depth") == 0) & ~F.col("b1").isin("=", "."))
    kind = F.when(F.col("b1").isin("...", "&"), F.col("b2")).otherwise(F.col("b1"))
    return named.select("path", "from", F.substring("text", 2, 200).alias("name"), F.when(kind.rlike(r"^\\?[A-Za-z_]"), kind).alias("type"), F.col("visibility").isNotNull().alias("promoted"), "visibility")


@fact
def calls(t: DataFrame) -> DataFrame:
    """Calls of functions, methods and static methods: the name, how it is called, and on what."""
    how = F.when(F.col("b1").isin("->", "?->"), "method").when(F.col("b1") == "::", "static").when(F.lower("b1") == "new", "new").otherwise("function")
    some = _of(t, "word", "call").where((F.col("a1") == "(") & (F.lower("b1") != "function") & ~((how == "function") & F.lower("text").isin(*sorted(NO_CALLS))))
    return some.select("path", "n", "line", "class_name", "unit", "unit_line", "loop", "b1", "b3", "a1", "a2", "a3", F.col("text").alias("name"), how.alias("how"), F.when(how != "function", F.col("b2")).alias("on"))


@fact
def class_facts(t: DataFrame) -> DataFrame:
    """Class-like declarations with their kind, parent and interfaces' number."""
    kind = F.lower("text")
    heads = _of(t, "word").where(kind.isin("class", "interface", "trait", "enum") & F.col("a1").rlike(r"^\w+$") & ~F.col("b1").isin("::", "->", "new"))
    return heads.select("path", F.col("line"), kind.alias("class_kind"), F.col("a1").alias("class_name"), F.when(F.lower("a2") == "extends", F.col("a3")).alias("parent"))


@fact
def trait_uses(t: DataFrame) -> DataFrame:
    """(path, class_name, trait): the traits that classes use, by short name."""
    return _of(t, *NAMES).where("used").select("path", "class_name", F.substring_index("text", "\\", -1).alias("trait")).distinct()


# --- detectors --------------------------------------------------------------------------------------


def measured(tokens: DataFrame, t: DataFrame) -> DataFrame:
    """Units with lines, complexity, statements, nesting, calls and collaborators."""
    from brindle.sources.php import units

    made = calls(t).where("unit IS NOT NULL").groupBy("path", "class_name", "unit", "unit_line").agg(F.count("*").alias("calls"), F.countDistinct("on").alias("collaborators"))
    key = ["path", "class_name", "unit", "unit_line"]
    same = reduce(lambda a, b: a & b, [F.col(f"u.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key])
    rows = units(tokens).alias("u").join(made.alias("c"), same, "left")
    return rows.select("u.*", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("collaborators", F.lit(0)).alias("collaborators")).withColumn("lines", F.col("end_line") - F.col("unit_line") + 1)


def god_methods(units: DataFrame, lines: int = 80, complexity: int = 15, statements: int = 40, nesting: int = 4, calls_: int = 25, collaborators: int = 8, signals: int = 2) -> DataFrame:
    """Methods that are too large by several measures, or far too large by one."""
    tests = [F.col("lines") > lines, F.col("complexity") > complexity, F.col("statements") > statements, F.col("nesting") > nesting, (F.col("calls") > calls_) | (F.col("collaborators") > collaborators)]
    fires, confidence = vote(tests, signals, 58, 9, 96)
    huge = (F.col("lines") > 2 * lines) | (F.col("complexity") > 2 * complexity)
    plain = (F.col("statements") <= 1) & ~(tests[1] | tests[2] | tests[3])  # one statement that builds a value
    sure = F.when(huge, F.least(F.lit(96), confidence + 10)).otherwise(confidence)
    message = F.format_string("%s spans %d lines with complexity %d", _owner(), "lines", "complexity")
    return _finding(units.where((fires | huge) & ~plain), "SL101", "high", sure, message, _owner(), "unit_line")


def god_classes(units: DataFrame, t: DataFrame, lines: int = 300, methods: int = 20, public: int = 15, statements: int = 200, collaborators: int = 15, signals: int = 2) -> DataFrame:
    """Classes that are too large by several measures."""
    heads = functions(t)
    shown = heads.where("visibility = 'public' AND class_name IS NOT NULL").groupBy("path", "class_name").agg(F.count("*").alias("public"))
    size = units.where("class_name IS NOT NULL").groupBy("path", "class_name").agg(
        F.min("unit_line").alias("line"), (F.max("end_line") - F.min("unit_line") + 1).alias("lines"), F.count("*").alias("methods"),
        F.sum("statements").alias("statements"), F.max("collaborators").alias("collaborators"),
    )
    rows = size.join(shown, ["path", "class_name"], "left").withColumn("public", F.coalesce("public", F.lit(0)))
    fires, confidence = vote([F.col("lines") > lines, F.col("methods") > methods, F.col("public") > public, F.col("statements") > statements, F.col("collaborators") > collaborators], signals, 55, 9, 94)
    return _finding(rows.where(fires), "SL102", "high", confidence, F.format_string("%s has %d methods on %d lines", "class_name", "methods", "lines"), F.col("class_name"))


def dead_private_methods(t: DataFrame) -> DataFrame:
    """Private methods that their class neither calls nor names in a string; magic and attributed ones, and
    classes that call by variable names, are left alone."""
    heads = functions(t).where("visibility = 'private' AND class_name IS NOT NULL AND NOT attributed AND name NOT LIKE '\\\\_\\\\_%'")
    dynamic = _of(t, "variable", "word").where((F.col("b1").isin("->", "::") & F.col("sort").isin(sorts("variable")) & (F.col("a1") == "(")) | F.lower("text").isin("compact", "extract", "__call", "__callstatic")).select("path", "class_name")
    called = _of(t, "word", "call", "member").where(F.col("b1").isin("->", "?->", "::")).select("path", "class_name", F.lower("text").alias("key"))
    named = _of(t, "string").select("path", "class_name", F.lower(F.regexp_replace("text", "^.|.$", "")).alias("key"))
    rows = heads.withColumn("key", F.lower("name")).join(dynamic.distinct(), ["path", "class_name"], "left_anti")
    for use in (called, named):
        rows = rows.join(use.distinct(), ["path", "class_name", "key"], "left_anti")
    return _finding(rows, "SL105", "medium", 88, F.format_string("%s::%s() is private and has no caller", "class_name", "name"), _owner("name"))


def unused_dependencies(t: DataFrame) -> DataFrame:
    """Promoted constructor parameters of an object type that neither the class nor a trait of it reads: private ones,
    and protected ones of a class that no other extends. Of classes with an unknown trait nothing is said."""
    heads = functions(t).where("name = '__construct' AND class_name IS NOT NULL")
    wanted = parameters(t).where(F.col("type").rlike("^\\\\?[A-Z]")).join(heads.select("path", "from", "class_name", "line"), ["path", "from"])
    extended = class_facts(t).select(F.substring_index("parent", "\\", -1).alias("class_name")).where("class_name IS NOT NULL").distinct()
    open_ = wanted.where("visibility = 'protected'").join(extended, "class_name", "left_anti").unionByName(wanted.where("visibility = 'private'").select("class_name", *[c for c in wanted.columns if c != "class_name"]))
    uses, traits = trait_uses(t), class_facts(t).where("class_kind = 'trait'").select(F.col("class_name").alias("trait")).distinct()
    unknown = uses.join(traits, "trait", "left_anti").select("path", "class_name").distinct()
    reads = _of(t, "word", "call", "member").where(F.col("b1").isin("->", "?->") & (F.col("b2") == "$this")).select("path", "class_name", F.col("text").alias("name")).distinct()
    lent = uses.join(reads.select(F.col("class_name").alias("trait"), "name"), "trait").select("path", "class_name", "name")
    rows = open_.join(unknown, ["path", "class_name"], "left_anti").join(reads.unionByName(lent).distinct(), ["path", "class_name", "name"], "left_anti")
    return _finding(rows, "SL106", "medium", 88, F.format_string("%s never reads its dependency $%s", "class_name", "name"), _owner("name"))


def swallowed_exceptions(t: DataFrame) -> DataFrame:
    """Catch blocks that neither throw, print, call nor record anything, whatever other blocks they hold."""
    type_ = F.substring_index("a2", "\\", -1).alias("type")
    held = _of(t, "word").where("held_acts = 0").select("path", F.col("n").alias("from"), "line", "class_name", "unit", type_, F.col("held").alias("size"))
    broad, empty = F.col("type").isin(BROAD_TYPES), F.col("size") == 0
    sure = F.when(empty, F.when(broad, 96).otherwise(92)).otherwise(F.when(broad, 84).otherwise(66))
    key = F.concat_ws(":", _owner(), "type")
    found = held.withColumn("_k", F.row_number().over(Window.partitionBy("path", key).orderBy("from")))
    message = F.concat("type", F.when(empty, " is caught by an empty block").otherwise(" is caught and nobody learns of it"))
    return _finding(found, "SL107", "high", sure, message, F.when(F.col("_k") == 1, key).otherwise(F.concat_ws("#", key, "_k")))


def remark(text: Column) -> Column:
    """The words of a remark in small letters, without signs and without words that only point."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin("the", "your", "this", "own", "is", "just", "a"))


def _word(words: Column, k: int) -> Column:
    return F.coalesce(F.get(words, F.lit(k) if k >= 0 else F.size(words) + k), F.lit(""))


def elided(text: Column) -> Column:
    """Whether a comment stands where code was left out: dots around words or before one for what is kept, "rest of
    the code", "add your logic here", "implementation goes here". Longer comments speak about code."""
    w = remark(text)
    dotted = text.rlike(r"^(\.{2,}|\u2026)")
    framed = text.rlike(r"^\.{2,}\s*\S.*\.{2,}$")
    kept = dotted & _word(w, 0).isin(KEPT)
    left = _word(w, 0).isin(LEFT) & (_word(w, 1) == "of") & _word(w, 2).isin(HELD)
    noun = F.when(_word(w, 1) == "business", _word(w, 2)).otherwise(_word(w, 1))
    asked = _word(w, 0).isin(DEMANDS) & F.when(_word(w, 1) == "business", (noun == "logic") & (_word(w, 3) == "here")).otherwise(noun.isin(PLACED) & (_word(w, 2) == "here"))
    goes = _word(w, 0).isin(GOING) & (_word(w, 1) == "goes") & (_word(w, 2) == "here")
    plain = text.rlike(r"^\p{L}") | text.rlike(r"^\.{2,}")
    return (F.size(F.split(text, r"\s+")) <= LONGEST_REMARK) & (framed | kept | (plain & (left | asked | goes)))


def unwritten(text: Column) -> Column:
    """Whether a message says that a body is yet to be written: it begins with a mark for what is pending, ends with
    "not implemented", or is nothing but that or a stub. A message that goes on to say who declined is none."""
    w = remark(text)
    core = F.filter(w, lambda x: ~x.isin("yet"))
    ends = (_word(core, -1) == "implemented") & (_word(core, -2) == "not")
    bare = F.filter(core, lambda x: ~x.isin("method", "function", "feature", "implementation"))
    only = (F.size(bare) == 1) & _word(bare, 0).isin("unimplemented", "stub")
    early = lambda *words: reduce(lambda a, b: a & b, [_word(w, k) == x for k, x in enumerate(words)])
    begins = _word(w, 0).isin(PENDING) | early("not", "implemented", "yet") | early("not", "yet", "implemented") | early("to", "be", "implemented") | (F.lower(text).rlike(r"^\s*implement me\b"))
    return begins | ends | only


def placeholders(tokens: DataFrame, t: DataFrame) -> DataFrame:
    """Comments that stand for code, and bodies that only throw that they are not written."""
    text = F.trim(F.regexp_replace("text", r"^(//+|#+|/\*+)|\*+/$", ""))
    # written first: in one filter with the words' tests, too long a method to be compiled, every token would be slow
    remarks = written(_of(tokens, "comment").select("path", "text", "line", "class_name", "unit"))
    gaps = _finding(remarks.where(elided(text)), "SL112", "high", 92, text, F.concat_ws(":", _owner(), F.lit("elided")))
    message = F.regexp_replace("text", "^['\"]|['\"]$", "")
    only = written(_of(t, "string").where((F.col("b1") == "(") & (F.lower("b3") == "new") & (F.col("statements") == 1)).select("path", "class_name", "unit", "line", "text")).where(unwritten(message))
    return gaps.unionByName(_finding(only, "SL112", "high", 90, F.col("text"), F.concat_ws(":", _owner(), F.lit("unwritten"))))


def long_parameter_lists(t: DataFrame, most: int = 7) -> DataFrame:
    heads = functions(t).where("name <> '__construct'")
    counts = parameters(t).groupBy("path", "from").agg(F.count("*").alias("n")).where(F.col("n") > most)
    rows = counts.join(heads, ["path", "from"])
    return _finding(rows, "SL113", "medium", F.least(F.lit(95), 70 + 8 * (F.col("n") - most)), F.format_string("%s takes %d parameters", "name", "n"), _owner("name"))


def nested_ternaries(t: DataFrame) -> DataFrame:
    """Ternaries whose condition or branch is itself one: a second mark in the same part of the same brackets, or
    brackets that hold a ternary and stand for a whole branch or condition. Ternaries side by side, in arguments or in
    other expressions, are none; neither are chains of fallbacks."""
    marks = _of(t, "mark").where("part IS NOT NULL")
    branch = F.col("opened_after").isin("?", ":") & F.col("closed_before").isin(":", ")", ";", ",", "]")
    condition = (F.col("closed_before") == "?") & (F.col("opened_after").isin("=", "(", "[", ",", "=>", "?", ":", "{", ";") | F.lower("opened_after").isin("return", "echo", "print"))
    wrapped = (F.col("paren") > 0) & (F.col("opened") == "(") & (branch | condition)
    each = marks.groupBy("path", "class_name", "unit", "stops", "paren", "part").agg((F.count("*") - 1).alias("_same"), F.sum(wrapped.cast("int")).alias("_wrapped"), F.min("line").alias("line"))
    found = each.groupBy("path", "class_name", "unit", "stops").agg((F.sum(F.col("_same") + F.col("_wrapped")) + 1).alias("n"), F.min("line").alias("line")).where("n >= 2")
    found = found.withColumn("_k", F.row_number().over(Window.partitionBy("path", "class_name", "unit").orderBy("line", "stops")))
    return _finding(found, "SL114", F.when(F.col("n") >= 3, "medium").otherwise("low"), F.when(F.col("n") >= 3, 95).otherwise(90), F.format_string("%d ternaries in one expression", "n"), F.concat_ws("#", _owner(), "_k"))


def _static(t: DataFrame) -> DataFrame:
    """Static calls on what may be a model: a name that begins with a capital and is no facade."""
    on = F.substring_index("on", "\\", -1)
    return calls(t).where("how = 'static'").withColumn("model", on).where(on.rlike("^[A-Z]") & ~on.isin(NO_MODELS))


def queries_in_loops(t: DataFrame) -> DataFrame:
    """Static queries within a loop, once for each model and method of a unit."""
    rows = _static(t).where((F.col("loop") > 0) & F.col("name").isin(QUERIES) & (F.col("name") != "all"))
    first = rows.groupBy("path", "class_name", "unit", "model", "name").agg(F.min("line").alias("line"))
    return _finding(first, "SL204", "medium", 84, F.format_string("%s::%s() runs once per iteration", "model", "name"), F.concat_ws(":", _owner(), "model", "name"))


def whole_tables(t: DataFrame) -> DataFrame:
    """``Model::all()`` within a loop, or iterated as it is; followed by a call it is another detector's."""
    rows = _static(t).where("name = 'all' AND a2 = ')' AND a3 NOT IN ('->', '?->')")
    iterated = F.lower("a3") == "as"
    rows = rows.where((F.col("loop") > 0) | iterated)
    return _finding(rows, "SL210", "medium", F.when(F.col("loop") > 0, 88).otherwise(70), F.format_string("%s::all() loads every row", "model"), F.concat_ws(":", _owner(), "model"))


def many_dependencies(t: DataFrame, suffix: str = "Controller", most: int = 4, rule: str = "SL206") -> DataFrame:
    """Constructors of classes of one kind that ask for too many objects."""
    heads = functions(t).where((F.col("name") == "__construct") & F.col("class_name").endswith(suffix))
    counts = parameters(t).where(F.col("type").rlike("^\\\\?[A-Z]")).groupBy("path", "from").agg(F.count("*").alias("n")).where(F.col("n") > most)
    step, base, top = (4, 78, 92) if rule == "SL206" else (5, 68, 88)
    return _finding(counts.join(heads, ["path", "from"]), rule, "medium", F.least(F.lit(top), base + step * (F.col("n") - most)), F.format_string("%s depends on %d objects", "class_name", "n"), F.col("class_name"))


@fact
def routes(t: DataFrame) -> DataFrame:
    """Route registrations: verb, uri, and the controller and method of an array action."""
    text = lambda c: F.regexp_replace(c, "^.|.$", "")
    heads = calls(t).where("how = 'static' AND on = 'Route' AND name IN ('get', 'post', 'put', 'patch', 'delete', 'any')").select("path", F.col("n").alias("from"), "line", F.col("name").alias("verb"), text("a2").alias("uri"))
    window = Window.partitionBy("path").orderBy("n")
    own = heads.select("path", F.col("from").alias("n"), F.col("from").alias("_h"))
    string = F.col("sort").isin(sorts("string")) & (F.col("b2") == "class") & (F.col("b1") == ",")
    holds = (F.col("a1") == "::") & (F.col("a2") == "class")
    some = t.where(~F.col("sort").isin(sorts("call", "unit", "sign")) & (string | holds)).select("path", "n", "text", string.alias("string"), holds.alias("holds"))
    rows = some.unionByName(own, allowMissingColumns=True).withColumn("from", F.last("_h", ignorenulls=True).over(window)).where("_h IS NULL")
    action = rows.where("string").groupBy("path", "from").agg(F.min(F.struct("n", text("text").alias("method"))).alias("m"))
    holder = rows.where("holds").groupBy("path", "from").agg(F.min(F.struct("n", F.substring_index("text", "\\", -1).alias("c"))).alias("c"))
    return heads.join(action, ["path", "from"], "left").join(holder, ["path", "from"], "left").select("path", "line", "verb", "uri", F.col("c.c").alias("controller"), F.col("m.method").alias("method"))


def destructive_gets(found: DataFrame) -> DataFrame:
    """GET routes to an action that changes data, or whose address says so."""
    parts = F.transform(F.split(F.lower("uri"), "/"), lambda s: F.regexp_replace(s, "[{}?]", ""))
    exact = F.arrays_overlap(parts, F.array(*[F.lit(w) for w in MUTATING_WORDS]))
    begins = F.exists(parts, lambda s: reduce(lambda a, b: a | b, [s.startswith(f"{w}-") | s.startswith(f"{w}_") for w in MUTATING_WORDS]))
    acts = F.coalesce(F.lower("method").isin(MUTATING_ACTIONS), F.lit(False))
    rows = found.where((F.col("verb") == "get") & (acts | exact | begins))
    return _finding(rows, "SL213", F.when(acts | exact, "high").otherwise("medium"), F.when(acts, 90).when(exact, 85).otherwise(65), F.concat(F.lit("GET "), "uri"), F.concat(F.lit("GET "), "uri"))


def missing_actions(found: DataFrame, t: DataFrame) -> DataFrame:
    """Routes to a method that neither the controller nor its known ancestors and traits have; of controllers with an
    unknown ancestor or trait, with one that takes any call, or of a name that is not unique, nothing is said."""
    from brindle.operators.graphs import closure

    named = class_facts(t).where("class_kind IN ('class', 'trait')").select("path", "class_name", "class_kind", F.substring_index("parent", "\\", -1).alias("parent"))
    facts = named.select("class_name", "parent").distinct()
    # of names that several declarations share, nothing is known
    shared = named.groupBy("class_name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_name").alias("ancestor"))
    over = facts.where("parent IS NOT NULL").select("class_name", "parent").unionByName(trait_uses(t).select("class_name", F.col("trait").alias("parent"))).distinct()
    up = closure(over, "class_name", "parent").select("child", "ancestor")
    chain = facts.select(F.col("class_name").alias("child"), F.col("class_name").alias("ancestor")).unionByName(up).distinct()
    chain = written(chain)
    own = functions(t).select(F.col("class_name").alias("ancestor"), F.lower("name").alias("key"))
    foreign = chain.join(facts.select(F.col("class_name").alias("ancestor")).distinct(), "ancestor", "left_anti")
    unclear = chain.join(shared.unionByName(own.where("key = '__call'").select("ancestor")).distinct(), "ancestor", "left_semi")
    silent = foreign.unionByName(unclear).select(F.col("child").alias("controller")).distinct()
    has = chain.join(own, "ancestor").select(F.col("child").alias("controller"), "key").distinct()
    asked = found.where("controller IS NOT NULL AND method IS NOT NULL").withColumn("key", F.lower("method"))
    known = asked.join(named.where("class_kind = 'class'").select(F.col("class_name").alias("controller")).distinct(), "controller", "left_semi").join(silent, "controller", "left_anti")
    return _finding(known.join(has, ["controller", "key"], "left_anti"), "SL211", "high", 92, F.format_string("%s has no method %s", "controller", "method"), F.concat_ws("::", "controller", "method"))


def models_in_migrations(t: DataFrame) -> DataFrame:
    """Migrations that use a model, once for each."""
    rows = _static(t).where("path LIKE '%database/migrations/%'").select("path", "line", "model")
    first = rows.groupBy("path", "model").agg(F.min("line").alias("line"))
    return _finding(first, "SL216", "medium", 88, F.concat(F.lit("uses the model "), "model"), F.col("model"))


def irreversible_migrations(units: DataFrame, t: DataFrame) -> DataFrame:
    """Migrations whose ``up`` changes the schema while ``down`` is missing or does nothing."""
    here = F.col("path").like("%database/migrations/%")
    sides = units.where(here & F.col("unit").isin("up", "down")).select("path", "unit", "unit_line", "statements", F.lit(0).alias("schema"))
    schema = _of(t, "word").where(here & (F.col("unit") == "up") & (F.col("text") == "Schema")).select("path", "unit", "unit_line", F.lit(0).alias("statements"), F.lit(1).alias("schema"))
    found = sides.unionByName(schema).groupBy("path").agg(
        F.max("schema").alias("changes"), F.max((F.col("unit") == "down").cast("int")).alias("has_down"),
        F.max(((F.col("unit") == "down") & (F.col("statements") > 0)).cast("int")).alias("undoes"), F.min(F.when(F.col("unit") == "up", F.col("unit_line"))).alias("line"),
    )
    return _finding(found.where("changes = 1 AND (has_down = 0 OR undoes = 0)"), "SL215", "medium", 90, F.when(F.col("has_down") == 0, "down() is missing").otherwise("down() is empty"), F.lit("down"))


def unconstrained_keys(t: DataFrame) -> DataFrame:
    """Foreign key columns of migrations whose statement does not constrain them."""
    rows = _of(t, "word").where("path LIKE '%database/migrations/%' AND text IN ('foreignId', 'foreignIdFor', 'constrained', 'references')")
    key = F.col("text").isin("foreignId", "foreignIdFor")
    each = rows.groupBy("path", "semis").agg(F.max((~key).cast("int")).alias("bound"), F.min(F.when(key, F.struct("line", "a2"))).alias("at")).where("at IS NOT NULL AND bound = 0")
    column = F.regexp_replace("at.a2", "^['\"]|['\"]$", "")
    return _finding(each.withColumn("line", F.col("at.line")), "SL217", "low", 78, F.concat(F.lit("foreign key without a constraint: "), column), column)


def single_implementations(t: DataFrame) -> DataFrame:
    """Interfaces that exactly one class implements and no more than one other file names."""
    faces = class_facts(t).where("class_kind = 'interface'").select("path", "line", F.col("class_name").alias("name"))
    small = functions(t).groupBy(F.col("class_name").alias("name")).agg(F.count("*").alias("methods"))
    short = F.substring_index("text", "\\", -1).alias("name")
    done = _of(t, *NAMES).where("heir IS NOT NULL").groupBy(short).agg(F.countDistinct("path", "heir").alias("implementors"))
    named = _of(t, *NAMES).where("fresh").groupBy(short).agg(F.count("*").alias("files"))
    rows = faces.join(done, "name").join(named, "name", "left").join(small, "name", "left").where("implementors = 1 AND coalesce(files, 0) <= 2 AND coalesce(methods, 0) <= 3")
    return _finding(rows, "SL303", "low", 63, F.concat("name", F.lit(" has one implementation")), F.col("name"))


@fact
def bodies(t: DataFrame, ignored: tuple[str, ...] = ("__construct", "__invoke", "up", "down", "definition"), least: int = LONG) -> DataFrame:
    """(id, path, line, class_name, unit, statements, tokens, masked, hash, n_tokens): bodies of methods of
    enough statements. Variables, literals and classes of static calls are masked; their values are kept apart."""
    is_ = lambda *names: F.col("sort").isin(sorts(*names))
    masks = F.when(is_("variable"), "V").when(is_("string", "heredoc", "number"), "L").when(is_(*NAMES) & (F.col("a1") == "::"), "C")
    value = F.when(masks == "V", F.concat(F.lit("var:"), "text")).when(masks == "L", F.concat(F.lit("lit:"), "text")).when(masks == "C", F.concat(F.lit("class:"), "text"))
    # most methods are too short: their tokens are not gathered
    rows = t.where(F.col("unit").isNotNull() & F.col("class_name").isNotNull() & ~F.col("unit").isin(list(ignored)) & (F.col("statements") >= least))
    one = F.struct("n", F.coalesce(masks, "text").alias("token"), value.alias("value"))
    found = rows.groupBy("path", "class_name", "unit", "unit_line", "statements").agg(F.array_sort(F.collect_list(one)).alias("b"))
    tokens = F.transform("b", lambda x: x["token"])
    return found.select(
        F.concat_ws(":", "path", "class_name", "unit", "unit_line").alias("id"), "path", F.col("unit_line").alias("line"), "class_name", "unit", "statements", tokens.alias("tokens"),
        F.filter(F.transform("b", lambda x: x["value"]), lambda v: v.isNotNull()).alias("masked"), F.sha2(F.concat_ws("\x1f", tokens), 256).alias("hash"), F.size("b").alias("n_tokens"),
    )


def duplicate_bodies(found: DataFrame, least: int = 8) -> DataFrame:
    """Methods whose body has the structure of another one's: the group is counted, its members are not paired."""
    groups = found.groupBy("hash").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.min("id").alias("first")).where("n > 1")
    signals = [F.col("statements") >= 2 * least, F.col("paths") > 1, F.col("n") > 2]
    _, confidence = vote(signals, 0, 70, 7, 90)
    return _finding(found.join(groups, "hash"), "SL104", "medium", confidence, F.concat(F.lit("has the structure of "), (F.col("n") - 1).cast("string"), F.lit(" other bodies, first "), "first"), _owner())


def drifted_bodies(found: DataFrame, budget: int = 28, ratio: float = 0.08) -> DataFrame:
    """Bodies that differ from another by few tokens; each pair is reported at its shorter body. All that may differ by so
    few are compared, however many; pairs are written once, without their tokens, and asked for families and findings."""
    pairs = written(drift_pairs(found.select("id", "tokens", "hash"), budget, ratio, None)[0])
    sizes = family_sizes(pairs, "id_a", "id_b")
    here = found.select("id", "path", "line", "class_name", "unit", "n_tokens").withColumnRenamed("id", "id_a")
    place = found.select(F.col("id").alias("id_b"), F.col("path").alias("path_b"))
    rows = pairs.join(here, "id_a").join(place, "id_b").join(sizes.withColumnRenamed("member", "id_a"), "id_a")
    _, confidence = vote([F.col("ratio") <= 0.02, F.col("family") >= 3, F.col("path") != F.col("path_b")], 0, 60, 8, 88)
    said = F.format_string("differs from %s by %d of %d tokens", "id_b", "distance", "n_tokens")
    return _finding(rows, "SL111", "high", confidence, said, F.concat_ws("~", _owner(), "id_b"))


def references(t: DataFrame) -> DataFrame:
    """(path, source, target, line): qualified names that a file imports or writes out, by its first class."""
    space = _of(t, "word").where(F.lower("text") == "namespace").groupBy("path").agg(F.first("a1").alias("space"))
    own = class_facts(t).groupBy("path").agg(F.min(F.struct("line", "class_name")).alias("c")).join(space, "path", "left").select("path", F.concat_ws("\\", "space", "c.class_name").alias("source"))
    named = _of(t, *NAMES).where(F.col("text").contains("\\") & (F.lower("b1") != "namespace")).select("path", "line", F.regexp_replace("text", r"^\\", "").alias("target"))
    return named.join(own, "path").groupBy("path", "source", "target").agg(F.min("line").alias("line")).where("source <> target")


def layer_violations(refs: DataFrame, forbidden: list[tuple[str, str]]) -> DataFrame:
    """References from a layer to one that it may not use; both are patterns of names."""
    broken = reduce(lambda a, b: a | b, [matches_glob(F.col("source"), s) & matches_glob(F.col("target"), o) for s, o in forbidden], F.lit(False))
    return _finding(refs.where(broken), "SL304", "medium", 90, F.concat("source", F.lit(" uses "), "target"), F.concat_ws("->", "source", "target"))


def boundary_violations(refs: DataFrame, module: str, public: list[str], shared: list[str]) -> DataFrame:
    """References into another module's internals."""
    free = reduce(lambda a, b: a | b, [matches_glob(F.col("target"), g) for g in public], F.lit(False))
    rows = refs.where(crosses_boundary(F.col("source"), F.col("target"), module, free, shared))
    return _finding(rows, "SL306", "medium", 90, F.concat("source", F.lit(" reaches into "), "target"), F.concat_ws("->", "source", "target"))


def forbidden_capabilities(t: DataFrame, roles: list[tuple[str, list[str]]]) -> DataFrame:
    """What a class does and its kind may not, once for each method and capability: (name pattern, capabilities)."""
    made = calls(t).where("class_name IS NOT NULL")
    can = reduce(lambda c, p: (F.when if c is None else c.when)(p[1], p[0]), [(name, test()) for name, test in CAPABILITIES.items()], None)
    rows = made.withColumn("can", can).where("can IS NOT NULL")
    forbidden = reduce(lambda a, b: a | b, [matches_glob(F.col("class_name"), g) & F.col("can").isin(list(no)) for g, no in roles], F.lit(False))
    first = rows.where(forbidden).groupBy("path", "class_name", "unit", "can").agg(F.min("line").alias("line"))
    return _finding(first, "SL305", "medium", 85, F.concat("class_name", F.lit(" may not: "), "can"), F.concat_ws(":", _owner(), "can"))


# What calls tell about a class, by name.
CAPABILITIES = {
    "http": lambda: (F.col("on") == "Http") & (F.col("how") == "static") | F.col("name").isin("curl_init", "curl_exec"),
    "mail": lambda: (F.col("on") == "Mail") & (F.col("how") == "static"),
    "log": lambda: (F.col("on") == "Log") & (F.col("how") == "static") | (F.col("name") == "logger"),
    "cache": lambda: (F.col("on") == "Cache") & (F.col("how") == "static"),
    "files": lambda: (F.col("on") == "Storage") & (F.col("how") == "static") | F.col("name").isin("file_put_contents", "fopen", "unlink"),
    "database": lambda: (F.col("on") == "DB") & (F.col("how") == "static"),
}


@dataclass(frozen=True)
class Policies:
    """What a project allows itself. A policy that is not declared has nothing to check.

    ``layers``: pairs of name patterns, of which the first may not use the second. ``module``: a pattern whose
    first group names a class's module; others may use what ``public`` matches, and modules ``shared`` are open.
    ``capabilities``: name patterns of classes with the capabilities that they may not have.
    """

    layers: tuple[tuple[str, str], ...] = ()
    module: str | None = None
    public: tuple[str, ...] = ()
    shared: tuple[str, ...] = ()
    capabilities: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def declared(self) -> list[str]:
        """The rules that have a policy to enforce."""
        return [rule for rule, policy in (("SL304", self.layers), ("SL305", self.capabilities), ("SL306", self.module)) if policy]


FOUND = "rule string, severity string, confidence int, path string, line long, message string, fingerprint string"


def detect(tokens: DataFrame, without: frozenset[str] = frozenset(), policies: Policies = Policies()) -> DataFrame:
    """The findings of all detectors of this module but those of the rules ``without``, which are not planned at all.
    What detectors share is computed once, in the shared folder."""
    checkpoint_dir(tokens.sparkSession)
    tokens = written(tokens.where("asked").drop("asked", "kind", "nest", "brace"))
    t = context(tokens)
    t._facts = {}
    units = written(measured(tokens, t))
    found, bodies_, refs = routes(t), bodies(t), references(t)
    p = policies
    parts = {
        "SL104": lambda: duplicate_bodies(bodies_), "SL111": lambda: drifted_bodies(bodies_),
        "SL101": lambda: god_methods(units), "SL102": lambda: god_classes(units, t), "SL105": lambda: dead_private_methods(t), "SL106": lambda: unused_dependencies(t),
        "SL107": lambda: swallowed_exceptions(t), "SL112": lambda: placeholders(tokens, t), "SL113": lambda: long_parameter_lists(t), "SL114": lambda: nested_ternaries(t),
        "SL204": lambda: queries_in_loops(t), "SL206": lambda: many_dependencies(t), "SL207": lambda: many_dependencies(t, "Service", 7, "SL207"), "SL210": lambda: whole_tables(t),
        "SL211": lambda: missing_actions(found, t), "SL213": lambda: destructive_gets(found), "SL215": lambda: irreversible_migrations(units, t), "SL216": lambda: models_in_migrations(t),
        "SL217": lambda: unconstrained_keys(t), "SL303": lambda: single_implementations(t),
    }
    declared = {
        "SL304": lambda: layer_violations(refs, list(p.layers)), "SL305": lambda: forbidden_capabilities(t, [(g, list(no)) for g, no in p.capabilities]),
        "SL306": lambda: boundary_violations(refs, p.module, list(p.public), list(p.shared)),
    }
    parts |= {rule: declared[rule] for rule in p.declared()}
    nothing = tokens.sparkSession.createDataFrame([], FOUND)
    return reduce(DataFrame.unionByName, [make() for rule, make in parts.items() if rule not in without], nothing)
