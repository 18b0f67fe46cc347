"""Mapping of hand-typed names to the entry of a reference list that is meant. Built-in functions only.

A typed value is cleaned of what surrounds names (quotes, aliases, hints, database) and cut into words. Words that the list
doesn't have are taken for abbreviations of its words where only one suits, or where one makes most values names of the list.
With these written out, the words are joined without separators, and so are those of the entries, in order or with the prefix
last. Values and entries meet by the pigeonhole principle: a form cut into k + 1 segments keeps one of them whole under k edits,
so an equality join on segments at their possible places finds all pairs within k. The built-in levenshtein verifies, and an
anti-join reports values that no entry suits. Values whose words aren't separated and are abbreviated besides are read from
their start on, by equality joins of their beginnings with the known spellings of words, as often as entries have words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.scratch import Scratch

#: Levenshtein edits within which the join finds pairs; two swaps of neighbouring letters take four.
MAX_EDITS = 4
#: Slips that a value may have; a slip is a letter too many, missing, wrong, or two swapped.
MAX_SLIPS = 2
#: Words read between two writes where words aren't separated.
ROUNDS = 4
#: Letters with marks, and the letters they are typed for.
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(value: Column) -> Column:
    """Database, schema and table of a typed value, as far as given; [] for what can't be a stored table."""
    v = F.regexp_replace(value, r"[\[\]\"`]", "")
    v = F.regexp_replace(v, r"\xA0", " ")
    v = F.regexp_replace(v, r"(?i)\s+with\s*\([^)]*\)\s*;*\s*$", "")
    v = F.regexp_replace(v, r"[\s;]+$|^\s+", "")
    v = F.regexp_replace(v, r"(?i)\s+as\s+\w+$", "")
    v = F.regexp_replace(v, r"\s+[A-Za-z]$", "")
    parts = F.filter(F.split(F.trim(v), r"\s*[./]+\s*"), lambda x: x != "")
    return F.when(value.rlike(r"^\s*[#@(]"), F.array().cast("array<string>")).otherwise(parts)


def _words(name: Column) -> Column:
    """Words of a table name: at separators and at capitals within; without a leading tbl."""
    plain = F.translate(F.translate(name, MARKED, PLAIN), MARKED.upper(), PLAIN.upper())
    split = F.split(F.lower(F.regexp_replace(plain, r"([a-z])([A-Z])", "$1_$2")), r"[^a-z0-9#@$]+")
    first = lambda w: F.get(w, F.lit(0))
    without = lambda w: F.when((first(w) == "tbl") & (F.size(w) > 1), F.slice(w, F.lit(2), F.size(w))).otherwise(w)
    joined = lambda w: F.when(F.size(w) == 1, F.array(F.regexp_replace(first(w), r"^tbl(?=[a-z]{6})", ""))).otherwise(w)
    return _bind(F.filter(split, lambda x: x != ""), lambda w: _bind(without(w), joined))


def _slips(a: Column, b: Column, edits: Column) -> Column:
    """Slips between two words within so many Levenshtein edits. A swap is two edits that change no letter count: with m letters
    that differ in count, edits = m + 2 * swaps and slips = m + swaps."""
    common = F.aggregate(
        F.array(*[F.lit(c) for c in LETTERS]),
        F.lit(0),
        lambda acc, c: acc + F.least(F.length(a) - F.length(F.replace(a, c, F.lit(""))), F.length(b) - F.length(F.replace(b, c, F.lit("")))),
    )
    m = F.greatest(F.length(a), F.length(b)) - common
    return (edits + m) / 2


def _near(a: Column, b: Column) -> Column:
    """One slip apart: one edit, or two neighbours swapped."""
    d = F.levenshtein(a, b, 2)
    same_letters = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    return (d == 1) | ((d == 2) & same_letters)


def _cut(length: str, k: int, i: str = "i") -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of the k + 1 segments of a string."""
    start = F.expr(f"{length} * {i} div {k + 1}")
    return start.cast("int"), (F.expr(f"{length} * ({i} + 1) div {k + 1}") - start).cast("int")


def pigeonhole_pairs(values: DataFrame, forms: DataFrame, k: int = MAX_EDITS) -> DataFrame:
    """All pairs of values and forms of the same scope within k Levenshtein edits: scope, v, f, edits.

    values: scope, v; forms: scope, f; distinct and not null. Forms of k characters or fewer have empty segments and aren't
    matched but for equality. Of a value of length n, only segments of forms of length n - k to n + k are probed, and segment i
    only where at most i edits lie before it and k - i behind it.
    """
    start, size = _cut("L", k)
    segment = F.explode(F.sequence(F.lit(0), F.lit(k))).alias("i")
    seg = forms.select("scope", "f", F.length("f").alias("L")).select("*", segment).select("scope", "f", "L", "i", start.alias("start"), size.alias("size")).filter("size > 0")
    seg = seg.select("scope", "f", "L", "i", F.expr("substring(f, start + 1, size)").alias("piece"))
    # Each value makes some hundred probes, so even few values are worth all cores.
    spread = values.repartition(max(values.sparkSession.sparkContext.defaultParallelism, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "v")
    probe = spread.select("scope", "v", F.length("v").alias("n"))
    probe = probe.select("*", F.explode(F.sequence(F.greatest(F.lit(k + 1), F.col("n") - k), F.greatest(F.lit(k + 1), F.col("n") + k))).alias("L"))
    probe = probe.select("*", segment).select("*", start.alias("start"), size.alias("size"))
    low = F.greatest(-F.col("i"), F.col("n") - F.col("L") - (k - F.col("i")), -F.col("start"))
    high = F.least(F.col("i"), F.col("n") - F.col("L") + (k - F.col("i")))
    probe = probe.select("*", low.alias("lo"), high.alias("hi")).filter("lo <= hi").select("*", F.explode(F.sequence("lo", "hi")).alias("shift"))
    probe = probe.select("scope", "v", "L", "i", F.expr("substring(v, start + shift + 1, size)").alias("piece"))
    edits = F.levenshtein("v", "f", k).alias("edits")
    found = probe.join(seg, ["scope", "L", "i", "piece"]).select("scope", "v", "f", edits)
    equal = values.join(forms, (values["scope"] == forms["scope"]) & (F.col("v") == F.col("f"))).select(values["scope"], "v", "f", F.lit(0).alias("edits"))
    return found.filter("edits >= 0").unionByName(equal).distinct()


def _abbreviations(typed: DataFrame, refs: DataFrame, vocabulary: DataFrame, listed: DataFrame) -> DataFrame:
    """Abbreviations among the words of values and the word that each stands for: w, word.

    An abbreviation has at least three letters and at most two thirds of the word's, begins like it and has its letters in the
    word's order. It stands for the only word that it begins, else for the only word that it suits; of several, for the one that
    makes most values names of entries, and so if it may be a slip for other words. What is listed counts first.
    """
    word = typed.select(F.explode("words").alias("w")).distinct()
    strange = word.join(vocabulary, F.col("w") == F.col("word"), "left_anti")
    # Both meet on the first three letters of the abbreviation: three letters of the word, the first one its initial.
    # Of the second letter the first place counts, so a word has no more of them than pairs of letters.
    behind = "substring(word, instr(substring(word, 2), a) + 2)"
    triples = F.expr(f"flatten(transform(array_distinct(split(substring(word, 2), '')), a -> transform(array_distinct(split({behind}, '')), b -> concat(substring(word, 1, 1), a, b))))")
    ways = vocabulary.filter(F.length("word") >= 3).select("word", F.explode(triples).alias("triple"))
    short = strange.filter(F.col("w").rlike("^[a-z]{3,}$")).join(ways, F.substring("w", 1, 3) == F.col("triple")).filter(F.length("w") * 3 <= F.length("word") * 2)
    short = short.filter(F.rlike("word", F.concat(F.lit("^"), F.array_join(F.split("w", ""), ".*")))).select("w", "word").distinct()
    slips = pigeonhole_pairs(strange.select(F.lit("").alias("scope"), F.col("w").alias("v")), vocabulary.select(F.lit("").alias("scope"), F.col("word").alias("f")), 2)
    short = short.join(listed.select("w"), "w", "left_anti").withColumn("starts", F.col("word").startswith(F.col("w")).cast("int"))
    slips = slips.filter(_near(F.col("v"), F.col("f"))).select(F.col("v").alias("w"), F.col("f").alias("word")).join(short.select("w"), "w", "left_semi")
    per = short.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("starts").alias("n_starts"))
    per = per.join(slips.select("w", F.lit(True).alias("is_slip")).distinct(), "w", "left")
    short = short.join(per, "w")
    only = F.col("is_slip").isNull() & ((F.col("n_starts") == 1) & (F.col("starts") == 1) | (F.col("n_starts") != 1) & (F.col("n") == 1))
    given = listed.join(vocabulary, "word", "left_semi").join(vocabulary.select(F.col("word").alias("w")), "w", "left_anti").select("w", "word")
    scratch = Scratch(typed.sparkSession, "abbreviations")
    sure = scratch.save(short.filter(only).select("w", "word").unionByName(given))
    open_ = short.select("w", "word").unionByName(slips).distinct()
    open_ = scratch.save(open_.join(sure.select("w"), "w", "left_anti"))
    words = typed.select("raw", "schema", F.posexplode("words").alias("pos", "w")).join(sure, "w", "left").join(open_.select("w").distinct().withColumn("is_open", F.lit(1)), "w", "left")
    words = words.groupBy("raw", "schema").agg(F.sum("is_open").alias("n_open"), F.min(F.when(F.col("is_open") == 1, F.col("w"))).alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", "w").alias("x")))), lambda p: p["x"]).alias("ws"))
    names = refs.select(F.array_join("words", " ").alias("name"), F.explode(F.array("schema", F.lit(""))).alias("scope")).distinct()
    tried = words.filter("n_open = 1").join(open_, "w").select("raw", "w", "word", F.coalesce("schema", F.lit("")).alias("scope"), F.array_join(F.transform("ws", lambda x: F.when(x == F.col("w"), F.col("word")).otherwise(x)), " ").alias("name"))
    votes = tried.join(names, ["name", "scope"], "left_semi").groupBy("w", "word").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("w", "votes").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("word")).groupBy("w").agg(F.max(F.struct("votes", "n", "word")).alias("b"))
    return sure.unionByName(best.filter("b.n = 1").select("w", "b.word").join(short.select("w", "word"), ["w", "word"], "left_semi")).distinct()


def _read_through(clean: DataFrame, spellings: DataFrame, n_words: int, longest: int) -> DataFrame:
    """Values read as spellings of words without separators, with all words written out: raw, f.

    clean: raw, v; spellings: piece, word. Each of n_words rounds takes a spelling from the start of what is left; after every
    ROUNDS of them what is read to the end is put aside, and the work is done when nothing else is left.
    """
    scratch = Scratch(clean.sparkSession, "reading")
    pieces = spellings.unionByName(spellings.sparkSession.createDataFrame([("", "")], "piece string, word string"))
    state, found = clean.select("raw", "v", F.lit(1).alias("at"), F.lit("").alias("f")), None
    for done in range(0, n_words, ROUNDS):
        for _ in range(min(ROUNDS, n_words - done)):
            left = F.length("v") - F.col("at") + 1
            lengths = F.when(left > 0, F.sequence(F.lit(1), F.least(left, F.lit(longest)))).otherwise(F.array(F.lit(0)))  # 0: read to the end
            state = state.select("*", F.explode(lengths).alias("n")).withColumn("piece", F.expr("substring(v, at, n)")).join(pieces, "piece")
            state = state.select("raw", "v", (F.col("at") + F.col("n")).alias("at"), F.concat("f", "word").alias("f"))
        state = scratch.save(state)
        read = state.filter(F.col("at") > F.length("v")).select("raw", "f").distinct()
        found = read if found is None else found.unionByName(read)
        state = state.filter(F.col("at") <= F.length("v"))
        if state.isEmpty():
            break
    return found.distinct() if found is not None else clean.select("raw", F.col("v").alias("f")).limit(0)


def match_names(values: DataFrame, reference: DataFrame, value: str = "value", abbreviations: dict[str, str] | None = None) -> DataFrame:
    """The entry of the reference list that each typed value means.

    values: one column of distinct typed values. reference: qualified_name (schema.table), schema_name, table_name,
    database_name. An entry suits a value if its schema and database are those given, as far as given, if there are at most
    MAX_SLIPS slips between its name and the value's with abbreviations written out, and if the value has no word that occurs in
    other entries but not in this one. The entry with the fewest slips is meant; of two with as few, none. abbreviations are
    those known beforehand; all others are learnt from the values.

    Null values have no row. Empty values, temporary tables and what else names no stored table are unmatched. Without
    reference entries, all are. Result: value, qualified_name (null if none is meant).
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "matching")
    vals = values.select(F.col(value).alias("raw")).filter("raw is not null").distinct()
    # Exploded, so that the parts are computed once and not again for each use.
    parts = vals.select("raw", F.explode(F.array(_parts(F.col("raw")))).alias("p")).filter("size(p) > 0")
    part = lambda i: F.lower(F.translate(F.get(F.reverse("p"), F.lit(i)), MARKED, PLAIN))
    typed = parts.select("raw", part(1).alias("schema"), part(2).alias("db"), _words(F.get(F.reverse("p"), F.lit(0))).alias("words")).filter("size(words) > 0")
    typed = scratch.save(typed)
    refs = reference.select("qualified_name", F.lower("schema_name").alias("schema"), F.lower("database_name").alias("db"), _words(F.col("table_name")).alias("words")).dropna(subset=["qualified_name"]).distinct()
    refs = scratch.save(refs)
    vocabulary = refs.select(F.explode("words").alias("word")).distinct()
    listed = spark.createDataFrame(sorted((abbreviations or {}).items()), "w string, word string")
    full = scratch.save(_abbreviations(typed, refs, vocabulary, listed))

    exploded = typed.select("raw", "schema", "db", F.posexplode("words").alias("pos", "w"))
    written = exploded.join(full, "w", "left").join(vocabulary.select(F.col("word").alias("w"), F.lit(True).alias("is_known")), "w", "left")
    clean = written.groupBy("raw").agg(
        F.first("schema").alias("schema"),
        F.first("db").alias("db"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", "w").alias("x")))), lambda s: s["x"]), "").alias("v"),
        F.collect_set(F.when(F.col("is_known") | F.col("word").isNotNull(), F.coalesce("word", "w"))).alias("known_words"),
        F.bool_or(F.col("is_known").isNull() & F.col("word").isNull()).alias("has_unknown"),
    )
    clean = scratch.save(clean)

    # Entries with their words joined, in order and with the first one last.
    turned = F.concat(F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))), F.slice("words", 1, 1))
    forms = scratch.save(refs.select("*", F.explode(F.array_distinct(F.array(F.array_join("words", ""), F.array_join(turned, "")))).alias("f")))

    # A value with a schema is compared with that schema's forms only, one without with those of all (scope "").
    any_schema = forms.select(F.explode(F.array("schema", F.lit(""))).alias("scope"), "f").distinct()
    near = pigeonhole_pairs(clean.select(F.coalesce("schema", F.lit("")).alias("scope"), "v").distinct(), any_schema)
    near = near.withColumn("slips", _slips(F.col("v"), F.col("f"), F.col("edits"))).filter(F.col("slips") <= MAX_SLIPS)
    near = near.withColumn("schema", F.nullif("scope", F.lit(""))).drop("scope")
    suits = clean.join(near, (clean["v"] == near["v"]) & clean["schema"].eqNullSafe(near["schema"])).select("raw", clean["schema"], "db", "known_words", "f", "slips")

    limits = refs.agg(F.coalesce(F.max(F.size("words")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("words", F.length))), F.lit(0))).first()
    spellings = vocabulary.select(F.col("word").alias("piece"), "word").unionByName(full.select(F.col("w").alias("piece"), "word"))
    through = _read_through(clean.filter("has_unknown"), spellings, *limits)
    suits = suits.unionByName(clean.join(through, "raw").select("raw", "schema", "db", "known_words", "f", F.lit(0.0).alias("slips")))

    suits = suits.join(forms.select("qualified_name", F.col("schema").alias("rs"), F.col("db").alias("rd"), F.col("words").alias("rw"), "f"), "f")
    suits = suits.filter((F.col("schema").isNull() | (F.col("schema") == F.col("rs"))) & (F.col("db").isNull() | (F.col("db") == F.col("rd"))))
    suits = suits.filter(F.size(F.array_except("known_words", "rw")) == 0)
    best = suits.groupBy("raw", "qualified_name").agg(F.min("slips").alias("slips")).groupBy("raw", "slips").agg(F.min("qualified_name").alias("one"), F.count(F.lit(1)).alias("n"))
    meant = best.groupBy("raw").agg(F.min(F.struct("slips", "n", "one")).alias("b")).filter("b.n = 1").select("raw", F.col("b.one").alias("qualified_name"))
    unmatched = vals.join(meant, "raw", "left_anti").select("raw", F.lit(None).cast("string").alias("qualified_name"))
    return meant.unionByName(unmatched).withColumnRenamed("raw", value)
