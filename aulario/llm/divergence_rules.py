"""Quality rules: base counts and the divergence of a text from references of its language.

A text has two histograms: its characters by class, and its common words (lower-cased words of up to
``COMMON_LENGTH`` letters that are among the ``TOP_WORDS`` most frequent of the language, all other
words being one bin). References are the same histograms over all documents of a language. A text is
kept if the base rules pass and neither Jensen-Shannon distance exceeds its limit; a text too short
for a histogram is not judged by it. The limit for words is a part of the distance that a text without
any common word has from the reference, as no text without them can be further away. A text of which
the reference expects too few common words strays that far by chance; it has the fixed limit.

Only DataFrame functions are used. The histograms of a row are built inside the row, so that nothing
but counts per language is shuffled; the features are written once to the shared folder.
Null texts are empty texts; a row with an unknown or null language is compared with the reference of
its own kind (null languages form one reference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aulario.plans.staging import stage

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
COMMON_LENGTH = 4
TOP_WORDS = 40
#: Fewest characters and words for which the two distances are judged, and their limits.
GUARD_CHARS, GUARD_WORDS = 250, 50
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.50
#: Part of the distance of a text without common words, and the expected common words from which it is the limit.
WORD_PART, WORDS_EXPECTED = 0.83, 26
#: Expected common words from which a judged text without any is rejected.
NONE_EXPECTED = 12
#: Parts into which the documents of one language are dealt when they meet its reference.
SALTS = 256

CLASSES = ("upper", "digit", "symbol", "mark", "space", "letter")


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _features(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))
    d = d.withColumn("rare", F.regexp_replace(text, r"[a-zà-ÿ\x20\x09-\x0D]+", ""))  # a twentieth of the text
    rare = F.col("rare")
    d = d.select(
        "doc_id",
        "lang",
        "words",
        F.size("words").alias("n_words"),
        F.length(text).alias("chars"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _removed(rare, r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        _removed(rare, r"\p{Lu}+").alias("upper"),
        _removed(rare, r"[0-9]+").alias("digit"),
        _removed(rare, r"[.,;:!?'\"()\-_/@+=~^{}\[\]]+").alias("mark"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1))).alias("hashes"),
        F.sort_array(
            F.filter(
                F.transform(F.filter("words", lambda w: F.length(w) <= COMMON_LENGTH), F.lower),
                lambda w: w.rlike("^[a-zà-ÿ]+$"),
            )
        ).alias("short"),
    )
    heads = F.filter(
        F.sequence(F.lit(0), F.size("short") - 1),
        lambda i: (i == 0) | (F.get("short", i) != F.get("short", i - 1)),
    )
    d = d.select(
        "doc_id", "lang", "n_words", "chars", "word_chars", "n_symbols", "upper", "digit", "mark", "short",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n_words") > WINDOW, F.col("hashes")).alias("windows"),
        F.when(F.size("short") > 0, heads).otherwise(F.array().cast("array<int>")).alias("heads"),
    )
    for step in (2, 4):  # hashes of 2, 4, then 8 words; using the column twice keeps Catalyst from inlining it
        d = d.withColumn("windows", F.transform("windows", lambda h, i: F.xxhash64(h, F.get("windows", i + step))))  # noqa: B023
    d = d.withColumn("windows", F.slice("windows", 1, F.size("windows") - WINDOW + 1))
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered))
    same = lambda j: F.get("ordered", j)["h"]
    twice = F.sort_array(
        F.transform(
            F.filter(
                F.transform("ordered", lambda x, j: F.struct(x["i"].alias("i"), ((x["h"] == same(j - 1)) | (x["h"] == same(j + 1))).alias("twice"))),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        twice,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    runs = F.transform(
        "heads",
        lambda p, j: F.struct(
            F.get("short", p).alias("w"), (F.coalesce(F.get("heads", j + 1), F.size("short")) - p).alias("n")
        ),
    )
    return d.select(
        "doc_id", "lang", "chars", F.col("n_words").cast("long"), "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        runs.alias("common"),
        F.map_from_arrays(
            F.array(*map(F.lit, CLASSES)),
            F.array(
                "upper", "digit", F.col("n_symbols").cast("int"), "mark", (F.col("chars") - F.col("word_chars")).cast("int"),
                (F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("n_symbols") - F.col("mark")).cast("int"),
            ),
        ).alias("classes"),
    )


def _term(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence, in bits."""
    part = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(0.0)
    return 0.5 * (part(p) + part(q))


def references(features: DataFrame) -> DataFrame:
    """Per language: share of each character class, and of each of its common words."""
    key = F.coalesce("lang", F.lit("")).alias("ref_lang")
    totals = features.groupBy(key).agg(
        *[F.sum(F.col("classes")[c]).alias(c) for c in CLASSES],
        F.sum("chars").alias("all_chars"),
        F.sum("n_words").alias("all_words"),
    )
    counted = features.select(key, F.explode("common").alias("c")).groupBy("ref_lang", "c.w").agg(F.sum("c.n").alias("n"))
    first = Window.partitionBy("ref_lang").orderBy(F.desc("n"), "w")
    top = counted.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= TOP_WORDS)
    top = top.join(totals.select("ref_lang", "all_words"), "ref_lang").groupBy("ref_lang").agg(
        F.map_from_entries(F.collect_list(F.struct("w", (F.col("n") / F.col("all_words")).alias("q")))).alias("ref_words"),
        F.sum(F.col("n") / F.col("all_words")).alias("ref_common"),
    )
    shares = F.map_from_arrays(F.array(*map(F.lit, CLASSES)), F.array(*[F.col(c) / F.col("all_chars") for c in CLASSES]))
    return totals.filter("all_chars > 0").select("ref_lang", shares.alias("ref_classes")).join(top, "ref_lang", "left")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, both distances, ``base_failed`` and ``kept``."""
    features = stage(_features(docs), "op10-features")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    known = references(features).withColumn("ref_salt", F.explode(salts))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) == F.col("ref_salt")
    f = features.join(known, (F.coalesce("lang", F.lit("")) == F.col("ref_lang")) & salt, "left")
    by_class = sum((_term(F.col("classes")[c] / F.col("chars"), F.col("ref_classes")[c]) for c in CLASSES), F.lit(0.0))
    known = F.filter(
        F.transform(
            "common",
            lambda x: F.struct((x["n"] / F.col("n_words")).alias("p"), F.col("ref_words")[x["w"]].alias("q")),
        ),
        lambda x: x["q"].isNotNull(),
    )
    total = F.aggregate(
        known,
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct(
            (a["d"] + _term(x["p"], x["q"])).alias("d"), (a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q")
        ),
    )
    f = f.withColumn("sums", total)
    rest = F.greatest(F.lit(0.0), 1 - F.col("sums.p"))
    by_word = F.col("sums.d") + 0.5 * (F.col("ref_common") - F.col("sums.q")) + _term(rest, 1 - F.col("ref_common"))
    root = lambda x: F.sqrt(F.greatest(F.lit(0.0), x))
    expected = F.col("n_words") * F.col("ref_common")
    farthest = root(0.5 * F.col("ref_common") + _term(F.lit(1.0), 1 - F.col("ref_common")))
    limit = F.when(expected >= WORDS_EXPECTED, F.least(F.lit(MAX_WORD_DISTANCE), WORD_PART * farthest)).otherwise(MAX_WORD_DISTANCE)
    without = (F.col("sums.p") == 0) & (expected >= NONE_EXPECTED)
    far = (F.col("n_words") >= GUARD_WORDS) & (F.coalesce(without, F.lit(False)) | (root(by_word) > limit))
    f = f.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("chars") >= GUARD_CHARS, root(by_class)).alias("class_distance"),
        F.when(F.col("n_words") >= GUARD_WORDS, root(by_word)).alias("word_distance"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.coalesce(far, F.lit(False)).alias("far"),
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & ~F.col("far")
    return f.withColumn("kept", ~F.col("base_failed") & near).drop("far")
