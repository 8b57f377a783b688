"""Shape-preserving, reversible pseudonyms for the values of a dataset.

All distinct eligible values of all chosen columns share one map, so joins between tables survive. A token keeps the value's shape:
upper case letters, lower case letters, digits and other letters are replaced within their class, everything else stays. No token is, or
contains, its value.

* Shapes with many values for the texts they allow (more than one in ``DENSE``) are permuted as a whole: a text is a number in mixed radix, and a
  keyed permutation without fixed points (Feistel rounds, a shift, and the rounds undone) gives another number of the same shape.
* Values of other shapes get hashes of (seed, value, position, attempt). Those whose tokens collide, or that keep their own text, try again
  with the next attempt; as the shape has room, few are left after each round.

The map is a table (value, token), applied and undone by joins; a join side is broadcast only after its size is checked. Dates and numbers
are shifted by one secret offset per run.

Defined cases: nulls, blanks, booleans, and numbers and dates unless wanted, are not eligible and stay; so do texts without letters and digits. An
eligible value that the map lacks is an error, or is masked, but never passes in clear. A shape of other letters than ASCII that is too
small for its values, as one Greek letter for thirty values, gives tokens of another shape.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.rng import salt_of
from fathom.operators.relational import small
from fathom.session import checkpoint

#: Rounds of hashing at most; every round leaves about one in DENSE of the values, so that more than twenty are never needed.
ROUNDS = 20
DENSE = 8
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: What other letters than those of ASCII become.
OTHER = "αβγδεζηθικλμνξοπρστυφχψω"
FEISTEL = 4
MASK = "[no pseudonym]"
MAX_DAYS, MAX_SHIFT = 1825, 10_000


def eligible(value: Column, numbers: bool = False, dates: bool = False) -> Column:
    """Whether a text is worth a token: not empty, no boolean, and no number or date unless wanted."""
    ok = value.isNotNull() & value.rlike(r"[\p{L}\p{N}]") & ~F.lower(value).isin("true", "false", "yes", "no")
    if not numbers:
        ok &= ~value.rlike(r"^[+-]?[0-9]+([.,][0-9]+)?$")
    if not dates:
        ok &= ~value.rlike(r"^[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}([T ].*)?$|^[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}$")
    return F.coalesce(ok, F.lit(False))


def shape(value: Column) -> Column:
    """A text with its letters and digits replaced by A, a and 0, and other letters and digits by ä."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0")
    return F.regexp_replace(plain, r"[\p{L}\p{N}&&[^\x00-\x7F]]", "ä")


def room(form: Column) -> Column:
    """How many texts a shape allows."""
    sizes = {"A": len(UPPER), "a": len(LOWER), "0": len(DIGITS), "ä": len(OTHER)}
    size = lambda ch: F.coalesce(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(n))])[ch], F.lit(1.0))
    return F.aggregate(F.split(form, ""), F.lit(1.0), lambda n, ch: n * size(ch))


def token(value: Column, seed: int, attempt: int) -> Column:
    """A text of the same shape. Each character takes 12 bits of MD5 digests of the value, ten characters to a digest."""
    blocks = F.sequence(F.lit(0), F.floor(F.char_length(value) / 10).cast("int"))
    digest = F.array_join(F.transform(blocks, lambda b: F.md5(F.concat_ws("|", F.lit(f"{seed}|{attempt}"), b.cast("string"), value))), "")
    bits = F.slice(F.regexp_extract_all(digest, F.lit("([0-9a-f]{3})"), F.lit(1)), F.lit(1), F.char_length(value))

    def one(ch: Column, piece: Column) -> Column:
        n = F.conv(piece, 16, 10).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        return F.when(ch.rlike("^[A-Z]$"), pick(UPPER)).when(ch.rlike("^[a-z]$"), pick(LOWER)).when(ch.rlike("^[0-9]$"), pick(DIGITS)).when(ch.rlike(r"^[\p{L}\p{N}]$"), pick(OTHER)).otherwise(ch)

    return F.array_join(F.zip_with(F.split(value, ""), bits, one), "")


def distinct_values(frames: list[tuple[DataFrame, list[str]]], **options) -> DataFrame:
    """(value) of all eligible texts of the columns given."""
    parts = [df.select(F.explode(F.array(*[F.when(eligible(F.col(f"`{c}`"), **options), F.col(f"`{c}`")) for c in columns])).alias("value")) for df, columns in frames]
    return reduce(DataFrame.unionByName, parts).where("value is not null").distinct()


def permuted(value: Column, seed: int) -> Column:
    """Another text of the same shape of ASCII letters and digits, one to one, by a permutation without fixed points of all texts of the
    shape, which may number up to 2^53. The key is part of the shape's own, so like shapes differ by seed only."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    radix = lambda c: F.when(c.rlike("^[A-Za-z]$"), 26).when(c.rlike("^[0-9]$"), 10).otherwise(1).cast("long")
    digit = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[A-Z]$"), F.ascii(c) - 65).when(c.rlike("^[a-z]$"), F.ascii(c) - 97).otherwise(0).cast("long")
    number = F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: n * radix(c) + digit(c))
    size = F.aggregate(chars, F.lit(1).cast("long"), lambda n, c: n * radix(c))
    # the last half of the characters is one side of the Feistel rounds
    low = F.aggregate(F.slice(chars, F.floor(F.size(chars) / 2).cast("int") + 1, F.size(chars)), F.lit(1).cast("long"), lambda n, c: n * radix(c))
    form = F.xxhash64(shape(value), F.lit(salt_of("permuted", seed)))
    base = F.struct(F.floor(number / low).cast("long").alias("a"), (number % low).alias("b"), low.alias("l"), F.floor(size / low).cast("long").alias("h"), form.alias("f"))

    def turned(k: int, sign: int) -> Callable[[Column], Column]:
        """Round k: a side moves by a hash of the other."""

        def turn(s: Column) -> Column:
            moved = lambda x, other, n: F.pmod(x + sign * F.pmod(F.xxhash64(other, s["f"], F.lit(k)), n), n)
            a, b = (moved(s["a"], s["b"], s["h"]), s["b"]) if k % 2 else (s["a"], moved(s["b"], s["a"], s["l"]))
            return F.struct(a.alias("a"), b.alias("b"), s["l"].alias("l"), s["h"].alias("h"), s["f"].alias("f"))

        return turn

    def shifted(s: Column) -> Column:
        n = s["l"] * s["h"]
        at = F.pmod(s["a"] * s["l"] + s["b"] + 1 + F.pmod(s["f"], F.greatest(n - 1, F.lit(1).cast("long"))), n)
        return F.struct(F.floor(at / s["l"]).cast("long").alias("a"), (at % s["l"]).alias("b"), s["l"].alias("l"), s["h"].alias("h"), s["f"].alias("f"))

    # one transform per step, so that no step's expression is written out more than once
    step = F.array(base)
    for k in range(FEISTEL):
        step = F.transform(step, turned(k, 1))
    step = F.transform(step, shifted)
    for k in reversed(range(FEISTEL)):
        step = F.transform(step, turned(k, -1))
    result = F.transform(step, lambda s: s["a"] * s["l"] + s["b"])[0]
    letter = lambda c, d: F.when(c.rlike("^[0-9]$"), F.char(d + 48)).when(c.rlike("^[A-Z]$"), F.char(d + 65)).when(c.rlike("^[a-z]$"), F.char(d + 97)).otherwise(c)
    back = F.aggregate(
        F.reverse(chars),
        F.struct(result.alias("n"), F.lit("").alias("t")),
        lambda s, c: F.struct(F.floor(s["n"] / radix(c)).cast("long").alias("n"), F.concat(letter(c, s["n"] % radix(c)), s["t"]).alias("t")),
    )
    return back["t"]


def build_map(values: DataFrame, seed: int) -> DataFrame:
    """(value, token), one to one; no token equals its value."""
    formed = checkpoint(values.select("value", shape(F.col("value")).alias("form")))
    crowded = formed.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * DENSE > room(F.col("form"))).select("form", F.lit(True).alias("dense"))
    split = checkpoint(formed.join(crowded, "form", "left").select("value", F.coalesce("dense", F.lit(False)).alias("dense"), F.col("form").contains("ä").alias("other")))
    done = checkpoint(split.where("dense and not other").select("value", permuted(F.col("value"), seed).alias("token")))
    rest = split.where("dense and other").select("value")
    todo = split.where("not dense").select("value")
    for attempt in range(ROUNDS):
        made = checkpoint(todo.withColumn("token", token(F.col("value"), seed, attempt)))
        # of several values with one token the least keeps it, unless an earlier round gave the token away
        firsts = made.groupBy("token").agg(F.min("value").alias("first"))
        ranked = checkpoint(made.join(firsts, "token").join(done.select("token", F.lit(True).alias("taken")), "token", "left"))
        good = (F.col("first") == F.col("value")) & F.col("taken").isNull() & (F.col("token") != F.col("value"))
        done = done.unionByName(ranked.where(good).select("value", "token"))
        todo = ranked.where(~good).select("value")
        if todo.isEmpty():
            break
    # shapes too small to go round: a hash, which holds nothing of the value
    rest = rest.unionByName(todo).withColumn("token", F.concat(F.lit("~"), F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), "value"), 256), 1, 24)))
    return done.unionByName(rest)


def _mapped(df: DataFrame, columns: list[str], mapping: DataFrame, source: str, target: str, lacking) -> DataFrame:
    table = small(mapping)
    for i, c in enumerate(columns):
        m = table.select(F.col(source).alias(f"__s{i}"), F.col(target).alias(f"__t{i}"))
        df = df.join(m, F.col(f"`{c}`") == F.col(f"__s{i}"), "left").withColumn(c, F.coalesce(F.col(f"__t{i}"), lacking(F.col(f"`{c}`")))).drop(f"__s{i}", f"__t{i}")
    return df


def apply_map(df: DataFrame, columns: list[str], mapping: DataFrame, missing: str = "fail", **options) -> DataFrame:
    """Values replaced by their tokens. An eligible value that the map lacks ends the job (``missing`` "fail"), or becomes MASK ("mask")."""
    hidden = (lambda c: F.lit(MASK)) if missing == "mask" else (lambda c: F.raise_error(F.lit("a value has no pseudonym")).cast("string"))
    return _mapped(df, columns, mapping, "value", "token", lambda c: F.when(eligible(c, **options), hidden(c)).otherwise(c))


def restore_map(df: DataFrame, columns: list[str], mapping: DataFrame) -> DataFrame:
    return _mapped(df, columns, mapping, "token", "value", lambda c: c)


def day_shift(seed: int) -> int:
    """The run's shift of dates in days: within five years and never 0."""
    n = salt_of("day_shift", seed) % (2 * MAX_DAYS) - MAX_DAYS
    return n if n < 0 else n + 1


def number_shift(seed: int) -> int:
    n = salt_of("number_shift", seed) % (2 * MAX_SHIFT) - MAX_SHIFT
    return n if n < 0 else n + 1


def shift_dates(df: DataFrame, columns: list[str], days: int) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") + F.expr(f"interval {days} days")).cast(df.schema[c].dataType) for c in columns})


def shift_numbers(df: DataFrame, columns: list[str], by: int) -> DataFrame:
    """Whole numbers wrap around the 64-bit range, so that shifting back restores them."""
    out = {}
    for c in columns:
        x = F.col(f"`{c}`")
        if dict(df.dtypes)[c] in ("bigint", "int", "smallint", "tinyint"):
            width = {"bigint": 64, "int": 32, "smallint": 16, "tinyint": 8}[dict(df.dtypes)[c]]
            low, span = F.lit(str(-(2 ** (width - 1)))).cast("decimal(38,0)"), F.lit(str(2**width)).cast("decimal(38,0)")
            out[c] = (F.pmod(x.cast("decimal(38,0)") + by - low, span) + low).cast(df.schema[c].dataType)
        else:
            out[c] = x + float(by)
    return df.withColumns(out)


#: Text forms of dates that are shifted, as pattern and Java format.
DATE_FORMS = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"))


def shift_text_dates(df: DataFrame, columns: list[str], days: int) -> DataFrame:
    """Dates written as texts in one of six forms; other texts stay."""
    out = {}
    for c in columns:
        s, made = F.col(f"`{c}`"), None
        for pattern, form in DATE_FORMS:
            moved = F.date_format(F.try_to_timestamp(s, F.lit(form)) + F.expr(f"interval {days} days"), form)
            made = F.when(s.rlike(pattern), moved) if made is None else made.when(s.rlike(pattern), moved)
        out[c] = F.coalesce(made, s)
    return df.withColumns(out)


def verify(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(check, ok): same columns and types, same row count, and same shapes per column."""
    checks = [("schema", F.lit(before.dtypes == after.dtypes))]
    sums = lambda d, p: d.agg(F.count(F.lit(1)).alias(f"{p}n"), *[F.sum(F.xxhash64(shape(F.col(f"`{c}`"))).cast("decimal(38,0)")).alias(f"{p}{i}") for i, c in enumerate(columns)])
    both = sums(before, "a").join(sums(after, "b"))
    checks += [("rows", F.col("an") == F.col("bn")), *[(f"shape:{c}", F.col(f"a{i}").eqNullSafe(F.col(f"b{i}"))) for i, c in enumerate(columns)]]
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), ok.alias("ok")) for n, ok in checks])).alias("x")).select("x.*")


def report(mapping: DataFrame) -> DataFrame:
    """(values, tokens, kept_shape, holding): distinct values and tokens, tokens with their value's shape, and tokens that hold their value."""
    return mapping.agg(F.count(F.lit(1)).alias("values"), F.count_distinct("token").alias("tokens"), F.count(F.when(shape(F.col("value")) == shape(F.col("token")), 1)).alias("kept_shape"), F.count(F.when(F.col("token").contains(F.col("value")), 1)).alias("holding"))
