"""Secret scans: fixed patterns, and strings that a character Markov model of random strings explains better than one
of ordinary identifiers. Everything runs as DataFrame operations.

Both models count character pairs of labelled samples; the log-likelihood ratio of a pair is one entry of a table of
fixed size, which becomes a constant of the plan. Only texts with a match go through the offset computation, where
offsets are running sums over match rows, so a text with many matches costs its length, not its square.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremora.llm.common import bounded, cut, free_names, text_of

#: The base patterns in listed order, and the least length of what each must hold.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
#: A candidate of the models: a whole run of these characters, this long at least.
RUN, LEAST_RUN = "[A-Za-z0-9+/_=-]", 16
CANDIDATE = f"{RUN}{{{LEAST_RUN},}}+"
KINDS = ("assign", "access", "hex", "markov")
PATTERNS = (ASSIGN, ACCESS, HEX, CANDIDATE)
#: Characters from + to z.
FIRST_CODE, CODES = 43, 80
#: Natural logarithm of the odds that a candidate must overcome: random strings are rare among identifiers.
MARGIN = math.log(1e5)
#: Numbers that the labelled samples of each class are written from.
SAMPLES = 4096
#: Words that identifiers are made of, in four languages, and prefixes that services put before tokens.
IDENTIFIER_WORDS = (
    "application array async author back base before between bottom buffer button "
    "cache category change channel character check child class client color column command comment config connection "
    "content context control count create current data date delete description directory document download "
    "element email error event example export extension feature field file filter first font format function general group "
    "header height history home html image import index information input instance integer item keyboard language "
    "layout length level library license link list local login manager margin message method model module month name network "
    "next notification number object option order output package page parameter parent path payment performance person point "
    "aber arbeit auch denken einheit entwicklung freundlich gesellschaft gleich heute immer keit lich machen mensch nicht "
    "richtig schaft schule sprache stunde ung unter verein wahrscheinlich wissenschaft wohnung zeichen zusammen zwischen "
    "alors apprendre aucun beaucoup chaque chose dernier donner encore enfant existence femme gouvernement heure homme jour "
    "leur maintenant maison moins monde nouveau oiseau pourquoi quelque raison souvent temps toujours travail trouver vieux "
    "agua amigo aunque bueno camino ciudad cuando desde despacio donde ella empezar entonces escuela familia fuerza gente "
    "guerra hermano llave mayor mientras mucho nombre palabra pueblo quien respuesta siempre tiempo trabajo vida"
)
RULED = "-=_+/x0"
TOKEN_PREFIXES = ("", "", "", "", "sk_live_", "ghp_", "xoxb-", "AIza", "glpat-", "npm_")


def _hashed(salt: str) -> Column:
    """64 hex digits that depend on the number and the salt only."""
    return F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)


def _picked(digits: Column, at: int, among: Column, n: int) -> Column:
    """One of the n entries of an array, by four hex digits."""
    return F.get(among, (F.conv(F.substring(digits, at, 4), 16, 10).cast("int") % n).cast("int"))


def random_samples(spark: SparkSession, n: int = SAMPLES, salt: str = "random") -> DataFrame:
    """(sample, random = true): hashed numbers in base64, letters with digits, and hex, some behind a token prefix.

    Lengths go from 16 to 64. The samples depend on nothing but n and salt.
    """
    digest = _hashed(salt)
    base64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(base64, "[^A-Za-z0-9]", "")
    chars = 16 + F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 28
    prefixes = F.array(*(F.lit(p) for p in TOKEN_PREFIXES))
    written = F.array(
        base64,
        F.concat(_picked(digest, 5, prefixes, len(TOKEN_PREFIXES)), F.substring(plain, F.lit(1), chars)),
        F.translate(F.upper(plain), "+/=", "XYZ"),
        digest,
    )
    return spark.range(n).select(F.explode(written).alias("sample"), F.lit(True).alias("random"))


def ordinary_samples(spark: SparkSession, n: int = SAMPLES, salt: str = "ordinary") -> DataFrame:
    """(sample, random = false): identifiers of two to four words in snake, kebab, path, camel, capital and joined
    style, with and without a number; decimal numbers, dates and UUIDs; rules, one character again and again. They
    depend on nothing but n and salt."""
    words = sorted(set(IDENTIFIER_WORDS.split()))
    digits, listed = _hashed(salt), F.split(F.lit(" ".join(words)), " ")
    drawn = F.slice(
        F.array(*(_picked(digits, at, listed, len(words)) for at in (1, 5, 9, 13))),
        1,
        2 + F.conv(F.substring(digits, 17, 1), 16, 10).cast("int") % 3,
    )
    capital = F.transform(drawn, lambda w: F.initcap(w))
    number = F.conv(F.substring(digits, 20, 2), 16, 10)
    long_number = F.conv(F.substring(digits, 22, 15), 16, 10)
    camel = F.concat(F.get(drawn, F.lit(0)), F.array_join(F.slice(capital, 2, 4), ""))
    date = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.conv(F.substring(digits, 40, 4), 16, 10).cast("int") % 30000), "yyyy-MM-dd")
    uuid = F.concat_ws("-", *(F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    rule = F.repeat(_picked(digits, 7, F.split(F.lit(RULED), ""), len(RULED)), F.conv(F.substring(digits, 11, 2), 16, 10).cast("int") % 48 + 16)
    snake = F.array_join(drawn, "_")
    written = F.array(
        snake, F.array_join(drawn, "-"), F.array_join(drawn, "/"), camel, F.array_join(capital, ""), F.array_join(drawn, ""),
        F.upper(snake), F.concat_ws("_", snake, number), F.concat(camel, number),
        F.array_join(F.transform(capital, lambda w, k: F.concat(w, F.substring(number, k + 1, F.lit(1)))), ""), long_number, F.concat(date, F.lit("-"), F.array_join(drawn, "-")),
        uuid, rule,
    )
    return spark.range(n).select(F.explode(written).alias("sample"), F.lit(False).alias("random"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs from samples(sample, random): CODES * CODES numbers.

    Both models are smoothed by adding one to each pair. Null and one-character samples teach nothing.
    """
    codes = F.transform(F.split("sample", ""), lambda c: F.ascii(c) - FIRST_CODE)
    pairs = (
        samples.where(F.length("sample") > 1)
        .select("random", codes.alias("codes"))
        .select("random", "codes", F.posexplode("codes").alias("at", "b"))
        .withColumn("a", F.get("codes", F.col("at") - 1))
        .where(f"a between 0 and {CODES - 1} and b between 0 and {CODES - 1}")
        .groupBy("random", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts: dict[bool, dict[tuple[int, int], int]] = {True: defaultdict(int), False: defaultdict(int)}
    after: dict[bool, dict[int, int]] = {True: defaultdict(int), False: defaultdict(int)}
    for r in pairs.collect():  # 2 * CODES * CODES rows at most
        counts[r["random"]][r["a"], r["b"]] = r["n"]
        after[r["random"]][r["a"]] += r["n"]

    def log(kind: bool, a: int, b: int) -> float:
        return math.log((counts[kind][a, b] + 1) / (after[kind][a] + CODES))

    return [log(True, a, b) - log(False, a, b) for a in range(CODES) for b in range(CODES)]


def ratio(candidate: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a candidate: positive where the model of random strings explains it better."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    total = F.aggregate(
        F.split(candidate, ""),
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(
            (F.ascii(c) - FIRST_CODE).alias("last"),
            (
                acc["sum"]
                + F.when(
                    acc["last"] >= 0, F.coalesce(F.get(table, acc["last"] * CODES + F.ascii(c) - FIRST_CODE), F.lit(0.0))
                ).otherwise(F.lit(0.0))
            ).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return total


def _matches(docs: DataFrame, model: list[float]) -> DataFrame:
    """(id, text_key, kind, k, before, value) for every match of docs(id, text_key, text), in one pass: before is the
    number of characters from the match of that kind before it. Texts without a match go no further."""
    text = F.col("text")
    random = F.exists(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda x: ratio(x, model) > MARGIN)
    shown = (text.rlike(ASSIGN), text.contains("AKIA"), text.rlike(HEX), random)
    kinds = F.filter(F.array(*(F.when(s, k) for s, k in zip(shown, KINDS, strict=True))), lambda k: k.isNotNull())
    read = docs.select("id", "text_key", "text", F.explode(kinds).alias("kind"))

    def by_kind(value) -> Column:
        chain = F.when(F.col("kind") == KINDS[0], value(PATTERNS[0]))
        for kind, pattern in zip(KINDS[1:], PATTERNS[1:], strict=True):
            chain = chain.when(F.col("kind") == kind, value(pattern))
        return chain

    gaps = F.transform(by_kind(lambda p: F.split("text", p, -1)), lambda p: F.length(p))
    found = by_kind(lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    # One array of both: what stands beside a generator is worked out again for every row that it makes.
    both = F.arrays_zip(gaps.alias("before"), found.alias("value"))
    each = read.select("id", "text_key", "kind", F.posexplode(both).alias("k", "match"))
    return each.select("id", "text_key", "kind", "k", "match.before", "match.value").where("value is not null")


def spans(docs: DataFrame, model: list[float]) -> DataFrame:
    """(id, text_key, kind, start, end, value, llr) of all secrets in docs(id, text_key, text), by code points.

    Models' spans that touch a base span are left out, as that one stays.
    """
    # Repeated rows of one id and text show the same matches.
    matches = _matches(docs, model).distinct()
    order = Window.partitionBy("id", "text_key", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = matches.withColumn("end", F.sum(F.col("before") + F.length("value")).over(order)).withColumn(
        "start", F.col("end") - F.length("value")
    )
    llr = F.when(F.col("kind") == "markov", ratio(F.col("value"), model))
    held = F.length(F.regexp_replace("value", ASSIGN_VALUE, ""))
    passing = (
        placed.withColumn("llr", llr)
        .where(
            F.when(F.col("kind") == "assign", held >= LEAST_VALUE)
            .when(F.col("kind") == "markov", F.col("llr") > MARGIN)
            .otherwise(F.lit(True))
        )
        .select("id", "text_key", "kind", "start", "end", "value", "llr")
    )
    # A base span that reaches over the start of a model's span, or starts within it.
    base = F.col("kind") != "markov"
    one, order = Window.partitionBy("id", "text_key"), F.when(base, 0).otherwise(1)
    running = (Window.unboundedPreceding, 0)
    reach = F.max(F.when(base, F.col("end"))).over(one.orderBy("start", order).rowsBetween(*running))
    following = F.min(F.when(base, F.col("start"))).over(one.orderBy(F.desc("start"), order.desc()).rowsBetween(*running))
    touched = (F.coalesce(reach, F.lit(0)) > F.col("start")) | (F.coalesce(following, F.col("end")) < F.col("end"))
    return passing.withColumn("touched", ~base & touched).where("not touched").drop("touched")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def default_model(spark: SparkSession) -> list[float]:
    """Trained on the labelled samples of this module, so a text's verdict doesn't hang on its neighbours."""
    return train(random_samples(spark).unionByName(ordinary_samples(spark)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """(doc_id, secrets) for each row of docs; secrets is an array of (start, rank, kind, end, llr) in order.

    Null texts count as empty and hold none. Repeated rows are scanned once and all get the result; ids may be null
    or repeat with other texts. Other columns aren't read; an empty table gives an empty result.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = spans(keyed, model if model is not None else default_model(docs.sparkSession))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    grouped = found.groupBy("id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "llr"))).alias("secrets")
    )
    none = F.array().cast(grouped.schema["secrets"].dataType)
    same = F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.text_key") == F.col("m.text_key"))
    return keyed.select("id", "text_key").alias("d").join(grouped.alias("m"), same, "left").select(
        F.col("d.id").alias("doc_id"), F.coalesce("secrets", none).alias("secrets")
    )


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None
) -> DataFrame:
    """docs with <kind> in place of every secret of the text column; spans that overlap give one mark.

    Rows without secrets, and null texts, stay as they are, and so do all other columns, whatever their names. An empty
    table stays empty.
    """
    found = spans(_keyed(docs, id_col, text_col), model if model is not None else default_model(docs.sparkSession))
    before = Window.partitionBy("id", "text_key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0)))
    first = F.when(F.col("start") >= F.col("at"), F.struct("start", "at", "kind"))
    id_, key, marks, last = free_names(docs, "marked_id", "marked_key", "marks", "last")
    grouped = placed.groupBy(F.col("id").alias(id_), F.col("text_key").alias(key)).agg(
        F.array_sort(F.collect_list(first)).alias(marks), F.max("end").alias(last)
    )
    text = F.col(text_col)
    size = F.greatest(F.lit(256), F.ceil(F.sqrt(F.length(text)))).cast("int")
    starts = F.sequence(F.lit(0), (F.length(text) / size).cast("int"))
    # Finding a place in a text costs the characters before it, so pieces are taken from short parts of it.
    parts = F.transform(starts, lambda k: F.substr(text, k * size + 1, size))

    def between(t: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / t["size"]).cast("int")
        joined = F.array_join(F.slice(t["parts"], first + 1, F.floor(end / t["size"]).cast("int") - first + 1), "")
        return F.substr(joined, (start - first * t["size"] + 1).cast("int"), (end - start).cast("int"))

    def written(t: Column) -> Column:
        pieces = F.transform(marks, lambda s: F.concat(between(t, s["at"], s["start"]), F.lit("<"), s["kind"], F.lit(">")))
        return F.concat(F.array_join(pieces, ""), between(t, F.col(last), t["length"]))

    # As the only element of an array, the parts are worked out once for all pieces.
    once = F.array(F.struct(parts.alias("parts"), size.alias("size"), F.length(text).alias("length")))
    marked = F.get(F.transform(once, written), F.lit(0))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_of(text_col)) == F.col(key))
    joined = docs.join(bounded(cut(grouped)), same, "left")
    return joined.withColumn(text_col, F.when(F.col(marks).isNull(), text).otherwise(marked)).select(*docs.columns)


def _joined(secrets: Column) -> Column:
    return F.array_join(
        F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans."""
    base = F.filter("secrets", lambda s: s["kind"] != "markov")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
        count("markov"),
    )
