"""Quality rules: how far a document's characters and common words lie from those of its language.

Native: DataFrame functions only. Two histograms describe a document, one of character classes and one of
its language's common words (each word, and all other words together). The reference of a language is
the same histogram summed over all its documents that are long enough; documents of languages that are
not named, or null, are held against the sum over all languages. The sums are a few hundred whole
numbers whatever the corpus, so they are read by the driver and become literals of the scoring pass. A document is rejected if a Jensen-Shannon distance (square root of
the divergence to base 2, from 0 to 1) exceeds its limit; a histogram of too few characters or words,
or a reference of too few, gives no verdict.

Defined results: a null or empty text has no words and fails the base rules; a null id is kept as it is;
repeated rows are judged alike; an empty table gives an empty one; extra columns are ignored by `measure`
and kept by `judge`, whatever their names, for its own columns have names of their own with a prefix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "was", "for", "on", "with", "as", "it", "at", "by", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "ein", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
#: Character classes, each taken from what the ones before it have left of a text.
CLASSES = {
    "lower": "\\p{Ll}+",
    "space": "[\\x20\\x09-\\x0D]+",
    "upper": "\\p{Lu}+",
    "point": "[.,;:'\"()?-]+",
    "digit": "\\p{Nd}+",
    "letter": "\\p{L}+",
}
N_CLASSES, N_WORDS = len(CLASSES) + 1, 17
SYMBOLS = "#*$%&|<>"
CLASS_LIMIT, WORD_LIMIT = 0.32, 0.32
MIN_CHARS, MIN_WORDS = 200, 60
MIN_REFERENCE = 20  # times the minimum length of a document
BASE_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def _computed(df: DataFrame, row: Column, names: list[str]) -> DataFrame:
    """Add the fields of a struct; a generator, which the optimizer neither merges nor repeats."""
    return df.select("*", F.explode(F.array(row)).alias("_row")).select(*df.columns, *(F.col(f"_row.{n}").alias(n) for n in names))


def _class_counts(text: Column) -> Column:
    """Characters of each class, the rest last."""

    def go(left: Column, patterns: list[str], counts: list[Column]) -> Column:
        if not patterns:
            return F.array(*[c.cast("long") for c in [*counts, F.length(left)]])
        after = F.regexp_replace(left, patterns[0], "")
        return _let(after, lambda x: go(x, patterns[1:], [*counts, F.length(left) - F.length(x)]))

    return go(text, list(CLASSES.values()), [])


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(""))


def _split(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, common.SPACES))


def _counted(docs: DataFrame) -> DataFrame:
    """Add _lang, the histograms _classes and _common (whole numbers) and the base measures."""
    variants = sorted({x for v in COMMON_WORDS.values() for w in v for y in (w, w.capitalize(), w.upper()) for x in (y, y + ",", y + ".")})
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(lists[F.col("_lang")], F.array(*map(F.lit, COMMON_WORDS["en"])))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)

    def common_counts(words: Column) -> Column:
        known = F.transform(F.filter(words, lambda w: w.isin(*variants)), lambda w: F.translate(F.lower(w), ".,", ""))
        counts = _let(known, lambda k: _let(own, lambda o: F.array(*[(F.size(k) - F.size(F.array_remove(k, o[j]))).cast("long") for j in range(N_WORDS - 1)])))
        return _let(counts, lambda c: F.concat(c, F.array(F.size(words).cast("long") - total(c))))

    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    row = _let(
        _split(F.col("_text")),
        lambda w: F.struct(
            _class_counts(F.col("_text")).alias("_classes"),
            common_counts(w).alias("_common"),
            F.size(w).cast("long").alias("_n_words"),
            F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("_n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("_n_dup_lines"),
            _repeat_words(w).cast("long").alias("_n_repeat_words"),
        ),
    )
    prepared = docs.withColumns({"_text": F.coalesce(F.col("text"), F.lit("")), "_lang": _language(F.col("lang"))})
    return _computed(prepared, row, COUNTS).drop("_text")


def _length(classes: Column) -> Column:
    return sum((classes[k] for k in range(1, N_CLASSES)), classes[0])


def references(counted: DataFrame) -> "References":
    """Summed histograms (classes, common words) of each named language over all documents that are long
    enough, and under "" over those of other languages."""
    long_enough = (_length(F.col("_classes")) >= MIN_CHARS) & (F.col("_n_words") >= MIN_WORDS)
    sums = [F.sum(F.col("_classes")[k]) for k in range(N_CLASSES)] + [F.sum(F.col("_common")[k]) for k in range(N_WORDS)]
    rows = counted.where(long_enough).groupBy("_lang").agg(*sums).collect()  # a row per named language
    found = {r[0]: ([*r[1 : 1 + N_CLASSES]], [*r[1 + N_CLASSES :]]) for r in rows}
    return {lang: found.get(lang, ([0] * N_CLASSES, [0] * N_WORDS)) for lang in [*COMMON_WORDS, ""]}


def distance(counts: Column, shares: Column) -> Column:
    """The Jensen-Shannon distance of a histogram of whole numbers to one of shares."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def term(a, both):
        return F.when(a > 0, a * F.log2(a / both)).otherwise(F.lit(0.0))

    def part(p, q):
        return (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2

    # totals and shares are lambda variables, so that each is computed once
    parts = F.transform(F.array(total), lambda t: F.zip_with(F.transform(counts, lambda c: c / t), shares, part))[0]
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def _by_language(refs, which: int, counts: Column, enough: Column, least: int) -> Column:
    """The distance to the reference of the row's language; null where it gives no verdict."""
    known = {lang: h[which] for lang, h in refs.items() if sum(h[which]) >= least * MIN_REFERENCE}
    if not known:
        return F.lit(None).cast("double")
    shares = F.create_map(
        *[x for lang, h in known.items() for x in (F.lit(lang), F.array(*[F.lit(float(c / sum(h))) for c in h]))]
    )[F.col("_lang")]
    return F.when(enough & F.col("_lang").isin(*known), distance(counts, shares))


def _repeat_words(words: Column) -> Column:
    """Words in windows found twice or more. Only a text with equal windows sorts their hashes; covered words
    are then counted from one repeated window to the next."""
    zero = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        same = lambda s, j, x: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = _let(ordered, lambda s: F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)))
        return _let(
            F.array_sort(F.transform(twice, lambda x: x["k"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), zero, lambda a, b: a + b
            ),
        )

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda k: F.xxhash64(F.slice(words, k, WINDOW)))
    counted = _let(hashes, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), zero).otherwise(covered(h)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(zero)


COUNTS = ["_classes", "_common", "_n_words", "_n_symbols", "_n_dup_lines", "_n_repeat_words"]


#: By language, the histograms of classes and of common words; "" is for languages that are not named.
References = dict[str, tuple[list[int], list[int]]]


def fitted(docs: DataFrame) -> References:
    """References of a corpus that is known to be good, to judge others by."""
    return references(_counted(docs.select("text", "lang")))


def measure(docs: DataFrame, keep: list[str], refs: References | None = None) -> DataFrame:
    """The columns to keep with the base measures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed) and the two distances (class_distance, word_distance), under names that begin with an
    underscore. Texts are read once. Without references their counts are stored and summed to some; a language that
    given references lack gives no verdict."""
    counted = _counted(docs).select(*keep, "_lang", *COUNTS)
    if refs is None:
        counted = common.store(counted)
        refs = references(counted)
    length = _length(F.col("_classes"))
    return counted.withColumns(
        {
            "_word_chars": length - F.col("_classes")[list(CLASSES).index("space")],
            "_class_distance": _by_language(refs, 0, F.col("_classes"), length >= MIN_CHARS, MIN_CHARS),
            "_word_distance": _by_language(refs, 1, F.col("_common"), F.col("_n_words") >= MIN_WORDS, MIN_WORDS),
            "_base_failed": (F.col("_n_words") < BASE_WORDS) | (100 * F.col("_n_repeat_words") > REPEAT_PERCENT * F.col("_n_words")),
        }
    )


def accepted() -> Column:
    """The verdict on a measured document."""
    return (
        ~F.col("_base_failed")
        & F.coalesce(F.col("_class_distance") <= CLASS_LIMIT, F.lit(True))
        & F.coalesce(F.col("_word_distance") <= WORD_LIMIT, F.lit(True))
    )


def judge(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """The documents that the rules keep, with their columns as they came; judged by the references given, else by those
    of docs itself."""
    rows = common.folded(docs, "doc_id", "text", "lang")
    return common.unfolded(measure(rows, rows.columns, refs).where(accepted()), docs)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, distances and verdict of every document.

    Null texts have no words and fail; null ids and repeated rows are rows like others; an empty table gives an empty
    one; a distance is null where it gives no verdict."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return measure(docs, ["doc_id"]).select(
        "doc_id",
        *(F.col(f"_{n}").alias(n) for n in names),
        accepted().alias("kept"),
        F.round("_class_distance", 6).alias("class_distance"),
        F.round("_word_distance", 6).alias("word_distance"),
    )


def _class_sql() -> str:
    """Successive removals, and the code points that each takes."""
    steps, left = [], "text"
    for k, pattern in enumerate(CLASSES.values()):
        steps.append(f"x{k} AS (SELECT *, regexp_replace({left}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS left{k} FROM {f'x{k - 1}' if k else 'd'})")
        left = f"left{k}"
    names = ["text", *(f"left{k}" for k in range(len(CLASSES)))]
    counts = [f"length({a}) - length({b})" for a, b in zip(names, names[1:], strict=False)] + [f"length({names[-1]})"]
    rows = " UNION ALL ".join(f"SELECT rid, lang, 0 AS kind, {j} AS j, {c} AS c FROM x{len(CLASSES) - 1}" for j, c in enumerate(counts))
    return ",\n".join([*steps, f"classes AS ({rows})"])


def _common_sql() -> str:
    lists = {**COMMON_WORDS, "": COMMON_WORDS["en"]}
    forms = [(lang, j, form) for lang, words in lists.items() for j, w in enumerate(words) for form in sorted({w, w.capitalize(), w.upper()})]
    return ", ".join(f"('{lang}', {j}, '{form}')" for lang, j, form in forms)


OP1_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) THEN lang ELSE '' END AS lang
  FROM documents
), {_class_sql()},
w AS (SELECT rid, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, text FROM d),
forms(lang, j, form) AS (VALUES {_common_sql()}),
one AS (SELECT rid, lang, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
hits AS (
  SELECT one.rid, one.lang, j, count(*) AS c FROM one JOIN forms ON forms.lang = one.lang AND form = regexp_replace(word, '[.,]$', '')
  GROUP BY ALL
), slots AS (SELECT rid, lang, unnest(range({N_WORDS - 1})) AS j, len(words) AS n FROM w),
words16 AS (SELECT s.rid, s.lang, 1 AS kind, s.j, coalesce(h.c, 0) AS c, n FROM slots s LEFT JOIN hits h ON h.rid = s.rid AND h.j = s.j),
common AS (
  SELECT rid, lang, kind, j, c FROM words16
  UNION ALL SELECT rid, lang, 1, {N_WORDS - 1}, any_value(n) - sum(c) FROM words16 GROUP BY rid, lang
), hist AS (SELECT * FROM classes UNION ALL SELECT * FROM common),
totals AS (SELECT rid, kind, sum(c) AS total FROM hist GROUP BY ALL),
lengths AS (SELECT a.rid, a.total AS chars, b.total AS n_words FROM totals a JOIN totals b ON b.rid = a.rid AND a.kind = 0 AND b.kind = 1),
refs AS (
  SELECT lang, kind, j, sum(c) AS c FROM hist JOIN lengths USING (rid) WHERE chars >= {MIN_CHARS} AND n_words >= {MIN_WORDS} GROUP BY ALL
), shares AS (
  SELECT lang, kind, j, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY lang, kind) AS DOUBLE) AS q FROM refs
  QUALIFY sum(c) OVER (PARTITION BY lang, kind) >= {MIN_REFERENCE} * CASE kind WHEN 0 THEN {MIN_CHARS} ELSE {MIN_WORDS} END
), pairs AS (
  SELECT h.rid, h.kind, CAST(h.c AS DOUBLE) / CAST(t.total AS DOUBLE) AS p, s.q FROM hist h JOIN totals t ON t.rid = h.rid AND t.kind = h.kind
  JOIN shares s ON s.lang = h.lang AND s.kind = h.kind AND s.j = h.j
  WHERE t.total >= CASE h.kind WHEN 0 THEN {MIN_CHARS} ELSE {MIN_WORDS} END
), distances AS (
  SELECT rid, kind, sqrt(greatest(0.0, sum(
    (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0.0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0.0 END) / 2
  ))) AS x FROM pairs GROUP BY ALL
), windows AS (
  SELECT rid, p, list_aggregate(words[p : p + {WINDOW - 1}], 'string_agg', ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM w WHERE len(words) >= {WINDOW})
), twice AS (SELECT rid, p FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (
  SELECT rid, sum(least({WINDOW}, coalesce(following - p, {WINDOW}))) AS n FROM (
    SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS following FROM twice
  ) GROUP BY rid
), lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), measured AS (
  SELECT d.rid, d.doc_id, CAST(l.n_words AS BIGINT) AS n_words, CAST(l.chars - sp.c AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    a.x AS class_x, b.x AS word_x
  FROM d JOIN lengths l USING (rid) JOIN classes sp ON sp.rid = d.rid AND sp.j = {list(CLASSES).index("space")}
  LEFT JOIN lines ON lines.rid = d.rid LEFT JOIN covered ON covered.rid = d.rid
  LEFT JOIN distances a ON a.rid = d.rid AND a.kind = 0 LEFT JOIN distances b ON b.rid = d.rid AND b.kind = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_x <= {CLASS_LIMIT}, true) AND coalesce(word_x <= {WORD_LIMIT}, true) AS kept,
  round(class_x, 6) AS class_distance, round(word_x, 6) AS word_distance
FROM (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM measured)
"""
