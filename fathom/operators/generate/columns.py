"""Column generators by name. A generator is a function of the row context and its options, and returns a Column."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.expressions import compile_expression, compile_template, is_template
from fathom.functions.rng import Rng, salt_of
from fathom.operators.generate.distributions import distribution


@dataclass
class Context:
    """Where a column is generated: ``row`` is the 0-based row number, ``rows`` their count, ``keys`` the sizes of parent tables."""

    seed: int
    entity: str
    name: str
    rows: int
    row: Column = field(default_factory=lambda: F.col("__row"))
    portable: bool = False
    schema: object = None
    parents: dict = field(default_factory=dict)
    model: dict = field(default_factory=dict)

    @property
    def rng(self) -> Rng:
        return Rng(self.seed, self.entity, self.row, self.portable)

    def uniform(self, *path: object) -> Column:
        return self.rng.uniform(self.name, *path)


@dataclass(frozen=True)
class Keys:
    """A parent's keys by row number. The key of row i is ``start + step * i``, with a prefix for texts, or what ``maker`` makes of i where the key's
    generator looks at its row only. Child keys then need no join. Keys that are ``joined`` follow no such rule and are looked up."""

    rows: int
    start: int = 1
    step: int = 1
    prefix: str | None = None
    maker: Callable[[Column], Column] | None = None
    joined: bool = False

    @property
    def plain(self) -> bool:
        """Whether a row number follows from its key by arithmetic."""
        return self.prefix is None and self.maker is None and not self.joined

    def at(self, index: Column) -> Column:
        if self.joined:
            raise ValueError("these keys are looked up, not computed")
        if self.maker:
            return self.maker(index)
        n = F.lit(self.start).cast("long") + F.lit(self.step) * index
        return F.concat(F.lit(self.prefix), n.cast("string")) if self.prefix is not None else n


Generator = Callable[..., Column]
GENERATORS: dict[str, Generator] = {}


def generator(name: str) -> Callable[[Generator], Generator]:
    """Register a generator; also the way to plug in one's own."""

    def register(f: Generator) -> Generator:
        GENERATORS[name] = f
        return f

    return register


@generator("constant")
def constant(ctx: Context, value: object = None) -> Column:
    return F.lit(value)


@generator("sequence")
def sequence(ctx: Context, start: int = 1, step: int = 1, prefix: str | None = None, width: int = 0) -> Column:
    n = F.lit(start).cast("long") + F.lit(step) * ctx.row
    if prefix is None:
        return n
    text = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.char_length(text) < width, F.lpad(text, width, "0")).otherwise(text))


@generator("temporal_sequence")
def temporal_sequence(ctx: Context, start: str = "2024-01-01", step_s: float = 60.0, jitter_s: float = 0.0) -> Column:
    shift = (ctx.row * step_s + (ctx.uniform("jitter") * 2 - 1) * jitter_s) * 1000
    return F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) + shift.cast("long"))


@generator("cyclic")
def cyclic(ctx: Context, values: list = ()) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (ctx.row % len(values) + 1).cast("int"))


@generator("uuid")
def uuid(ctx: Context) -> Column:
    """Version 4 by form, from MD5 of the row."""
    h = F.md5(F.concat_ws("|", F.lit(str(ctx.seed)), F.lit(ctx.entity), F.lit(ctx.name), ctx.row.cast("string")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


PATTERN_SETS = {"#": "0123456789", "?": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


@generator("pattern")
def pattern(ctx: Context, pattern: str = "###") -> Column:
    """# is a digit, ? a lower and A an upper case letter; anything else stays, also after a backslash.

    As many places as 50 bits hold share one draw, which is taken apart by division; digits in a row are one number.
    """
    places: list[tuple[str, str]] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            i += 1
            places.append(("", pattern[i]))
        elif ch == "#" and places and places[-1][0] == "#" and len(places[-1][1]) < 15:
            places[-1] = ("#", places[-1][1] + "#")
        else:
            places.append((ch if ch in PATTERN_SETS else "", ch))
        i += 1
    size = lambda kind, text: 10 ** len(text) if kind == "#" else 26
    parts, draw, left, below = [], 0, 1 << 50, 1
    for kind, text in places:
        if not kind:
            parts.append(F.lit(text))
            continue
        n = size(kind, text)
        if below * n > left:
            draw, below = draw + 1, 1
        value = F.floor(ctx.rng.uniform(ctx.name, draw) * float(left) / below).cast("long") % n
        below *= n
        parts.append(F.lpad(value.cast("string"), len(text), "0") if kind == "#" else F.char(value + (97 if kind == "?" else 65)))
    return F.concat(*parts)


@generator("one_of")
def one_of(ctx: Context, values: list = (), weights: list[float] | None = None) -> Column:
    return ctx.rng.weighted(list(values), list(weights or [1.0] * len(values)), ctx.name)


@generator("distribution")
def distribution_(ctx: Context, family: str = "uniform", params: dict | None = None, round: bool = False) -> Column:  # noqa: A002
    return distribution(ctx.rng, family, params or {}, ctx.name, round_=round)


@generator("derived")
def derived(ctx: Context, expression: str = "null") -> Column:
    return compile_template(expression, ctx.schema) if is_template(expression) else compile_expression(expression, ctx.schema, row=ctx.row, rng=ctx.rng)


@generator("conditional")
def conditional(ctx: Context, field: str = "", cases: dict | None = None, default: dict | None = None) -> Column:
    """A generator per value of another field."""
    out = None
    for value, spec in (cases or {}).items():
        test, made = F.col(f"`{field}`").cast("string") == str(value), make(ctx, spec, str(value))
        out = F.when(test, made) if out is None else out.when(test, made)
    return out.otherwise(make(ctx, default, "default")) if default else out


def make(ctx: Context, spec: dict, branch: str = "") -> Column:
    """The column of a spec {"type": name, ...options}; ``branch`` gives nested generators a stream of their own."""
    options = dict(spec)
    kind = options.pop("type")
    if kind not in GENERATORS:
        raise ValueError(f"unknown generator {kind}")
    inner = Context(ctx.seed, ctx.entity, f"{ctx.name}.{branch}" if branch else ctx.name, ctx.rows, ctx.row, ctx.portable, ctx.schema, ctx.parents, ctx.model)
    return GENERATORS[kind](inner, **options)


@generator("composite")
def composite(ctx: Context, element: dict | None = None, min_length: int = 0, max_length: int = 3) -> Column:
    """A JSON array of elements with a random length."""
    n = ctx.rng.integer(min_length, max_length, ctx.name, "length").cast("int")
    items = [make(ctx, element, str(i)) for i in range(max_length)]
    return F.to_json(F.slice(F.array(*items), F.lit(1), n))


@generator("struct")
def struct(ctx: Context, fields: dict | None = None) -> Column:
    return F.struct(*[make(ctx, spec, name).alias(name) for name, spec in (fields or {}).items()])


@generator("dictionary")
def dictionary(ctx: Context, values: list = (), mode: str = "sample") -> Column:
    """Values of a list: sampled, or each in turn in a shuffled order with a number added once the list is used up (suffix). In mode combinatorial the
    values are lists whose combinations come once each, joined by blanks, and then with a number."""
    if mode == "sample":
        return ctx.rng.pick(list(values), ctx.name)
    if mode == "combinatorial":
        total = math.prod(len(v) for v in values)
        lap, place, parts = F.floor(ctx.row / total).cast("long"), _scattered(ctx, ctx.row % total, total), []
        for v in values:
            parts.append(F.element_at(F.array(*[F.lit(x) for x in v]), (place % len(v) + 1).cast("int")))
            place = F.floor(place / len(v)).cast("long")
        made = F.concat_ws(" ", *parts)
        return F.when(lap == 0, made).otherwise(F.concat_ws(" ", made, lap.cast("string")))
    order = sorted(values, key=lambda v: salt(ctx, v))
    base = F.element_at(F.array(*[F.lit(v) for v in order]), (ctx.row % len(order) + 1).cast("int"))
    lap = F.floor(ctx.row / len(order)).cast("long")
    return base if mode == "shuffle" else F.when(lap == 0, base).otherwise(F.concat(base, F.lit("_"), lap.cast("string")))


def salt(ctx: Context, value: object) -> int:
    """A number of the column's own for a value."""
    return salt_of(ctx.seed, ctx.entity, ctx.name, value)


@generator("unique_int")
def unique_int(ctx: Context, low: int = 1, high: int = 1_000_000) -> Column:
    """Different whole numbers in [low, high] by a bijection of the row number: an affine step by a number coprime to the range."""
    span = high - low + 1
    if ctx.rows > span:
        raise ValueError("more rows than different values")
    return (_scattered(ctx, ctx.row, span) + low).cast("long")


def _scattered(ctx: Context, index: Column, span: int) -> Column:
    """A number in [0, span) for each of as many, one to one."""
    a = salt(ctx, "a") % span or 1
    while math.gcd(a, span) != 1:
        a += 1
    b = salt(ctx, "b") % span
    return F.pmod(index.cast("decimal(38,0)") * a + b, F.lit(span).cast("decimal(38,0)")).cast("long")


@generator("junction")
def junction(ctx: Context, parents: list[str] = (), side: int = 0, pair: str = "pair") -> Column:
    """One side of a many-to-many link between two parents. Fields with the same ``pair`` belong together; no pair of keys comes twice."""
    left, right = (ctx.parents[p] for p in parents)
    total = left.rows * right.rows
    if ctx.rows > total:
        raise ValueError("more rows than different pairs")
    at = _scattered(Context(ctx.seed, ctx.entity, pair, ctx.rows, ctx.row), ctx.row, total)
    return (left, right)[side].at(F.floor(at / right.rows).cast("long") if side == 0 else at % right.rows)


@generator("hierarchy")
def hierarchy(ctx: Context, max_depth: int = 5) -> Column:
    """The key of another row of the same table as parent, without circles and at most ``max_depth`` links deep; null at the top."""
    from fathom.operators.generate.graphs import parent_of

    parent, _ = parent_of(ctx.row, ctx.rows, ctx.rng, max_depth)
    return F.when(parent.isNotNull(), ctx.parents[ctx.entity].at(parent))


@generator("persona_field")
def persona_field(ctx: Context, field: str = "", trait: str = "", personas: str = "personas") -> Column:
    """A trait of the persona of another field's actor. Which persona an actor has is a hash of its key, so it is the same in every table."""
    kinds = ctx.model[personas]
    names = sorted(kinds)
    who = Rng(ctx.seed, f"persona:{personas}", F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("")), ctx.portable)
    place = who.weighted(list(range(1, len(names) + 1)), [float(kinds[n].get("weight", 1.0)) for n in names], "kind")
    values = [n if trait == "name" else kinds[n]["traits"].get(trait) for n in names]
    return F.when(F.col(f"`{field}`").isNotNull(), F.element_at(F.array(*[F.lit(v) for v in values]), place.cast("int")))


@generator("copula")
def copula(ctx: Context, family: str = "clayton", theta: float = 2.0, field: str = "") -> Column:
    """A uniform that depends on the uniform of another field by a Clayton or Frank copula."""
    from fathom.operators.generate import series

    u, t = F.greatest(F.col(f"`{field}`"), F.lit(1e-12)), F.greatest(ctx.uniform("copula"), F.lit(1e-12))
    return {"clayton": series.clayton, "frank": series.frank}[family](u, t, theta)


# --- references


@generator("fk")
def fk(ctx: Context, parent: str = "", selection: str = "uniform", window: int = 10, exponent: float = 1.0) -> Column:
    """A key of a parent with dense keys: uniform, sequential (round robin), clustered (near the row's own place) or zipf."""
    keys: Keys = ctx.parents[parent]
    n = keys.rows
    if selection == "sequential":
        index = ctx.row % n
    elif selection == "clustered":
        centre = F.floor(ctx.row * float(n) / max(1, ctx.rows))
        index = F.greatest(F.lit(0), F.least(F.lit(n - 1), centre + ctx.rng.integer(-window, window, ctx.name)))
    elif selection == "zipf":
        index = distribution(ctx.rng, "zipf", {"n": n, "s": exponent}, ctx.name) - 1
    else:
        index = ctx.rng.integer(0, n - 1, ctx.name)
    return keys.at(index.cast("long"))


def index_join(df: DataFrame, index: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of a parent whose keys follow no rule: its rows get a dense number by key order, and the child's ``index`` column picks one."""
    from fathom.operators.relational import row_index

    keys = row_index(parent.select(F.col(f"`{key}`").alias(name)).distinct(), [name], index)
    return df.join(keys, index)


def weighted_pick(df: DataFrame, uniform: str, parent: DataFrame, key: str, weight: str, name: str, bins: int = 1024) -> DataFrame:
    """A parent key per row, with probability proportional to a weight column.

    Parents get consecutive intervals of [0, 1) as wide as their share; a row takes the interval its uniform falls in. Both sides
    meet on equal slices of [0, 1): an interval joins every slice it overlaps, so this is an equi-join, and a heavy parent
    is spread over the slices it covers."""
    from fathom.operators.relational import prefix_sums

    positive = parent.select(F.col(key).alias(name), F.col(weight).cast("double").alias("__w")).where("__w > 0")
    total = positive.agg(F.sum("__w").alias("__t"))
    upto = prefix_sums(positive, [name], F.col("__w"), name="__to").join(F.broadcast(total))
    spans = upto.select(name, ((F.col("__to") - F.col("__w")) / F.col("__t")).alias("__lo"), (F.col("__to") / F.col("__t")).alias("__hi"))
    bin_of = lambda c: F.least(F.lit(bins - 1), F.floor(c * bins)).cast("long")
    spans = spans.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__lo")), bin_of(F.col("__hi")))))
    rows = df.withColumn("__bin", bin_of(F.col(uniform)))
    return rows.join(spans, "__bin").where((F.col(uniform) >= F.col("__lo")) & (F.col(uniform) < F.col("__hi"))).drop("__bin", "__lo", "__hi")


@generator("actor_temporal")
def actor_temporal(ctx: Context, start: str = "2024-01-01", days: int = 30, hour: float = 14.0, spread_h: float = 3.0) -> Column:
    """A time whose hour of the day is normal around a preferred hour, wrapped at midnight."""
    day = ctx.rng.integer(0, days - 1, ctx.name, "day")
    at = F.pmod(ctx.rng.normal(ctx.name, "hour") * spread_h + hour, F.lit(24.0))
    return F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) + day * 86_400_000 + (at * 3_600_000).cast("long"))


@generator("relative")
def relative(ctx: Context, field: str = "", mean_s: float = 3600.0, std_s: float = 0.0, min_s: float | None = None, max_s: float | None = None) -> Column:
    """Another time plus a normal or constant offset, within limits."""
    shift = F.lit(float(mean_s)) + (ctx.rng.normal(ctx.name) * std_s if std_s else F.lit(0.0))
    shift = F.greatest(F.lit(float(min_s)), shift) if min_s is not None else shift
    shift = F.least(F.lit(float(max_s)), shift) if max_s is not None else shift
    return F.timestamp_millis(F.unix_millis(F.col(f"`{field}`").cast("timestamp")) + (shift * 1000).cast("long"))


@generator("business_hours")
def business_hours(ctx: Context, start: str = "2024-01-01", end: str = "2024-12-31", open: int = 9, close: int = 17, days: list[int] = (0, 1, 2, 3, 4), holidays: list[str] = (), zone: str = "UTC") -> Column:  # noqa: A002
    """A time within opening hours of a working day (Monday 0). The days are enumerated once, on the driver."""
    from datetime import date, timedelta

    a, b = date.fromisoformat(start), date.fromisoformat(end)
    valid = [str(d) for d in (a + timedelta(n) for n in range((b - a).days + 1)) if d.weekday() in days and str(d) not in set(holidays)]
    day = F.unix_millis(ctx.rng.pick(valid, ctx.name, "day").cast("timestamp"))
    local = F.timestamp_millis(day + open * 3_600_000 + F.floor(ctx.uniform("time") * (close - open) * 3_600_000).cast("long"))
    return F.to_utc_timestamp(local, zone) if zone != "UTC" else local


# --- text

SYLLABLES = ["ba", "dor", "el", "fen", "gar", "hul", "is", "jor", "kel", "lum", "mar", "nel", "or", "pel", "quin", "ros", "sel", "tam", "ul", "ven", "wil", "yor", "zan"]
DOMAINS = ["example.com", "example.org", "example.net"]
WORDS = ["amber", "basin", "cedar", "delta", "ember", "fjord", "grove", "harbor", "island", "jasper", "kernel", "ledger", "meadow", "nectar", "orbit", "prairie", "quartz", "river", "summit", "timber", "umber", "valley", "willow", "zephyr"]
STREETS = ["Street", "Avenue", "Road", "Lane", "Way"]
KINDS = ["Ltd", "Inc", "Group", "Works", "Partners"]
COUNTRIES = ["Arvania", "Belmora", "Cordia", "Drelland", "Estaria", "Farrow"]


def _word(ctx: Context, *path: object, parts: int = 2) -> Column:
    return F.concat(*[ctx.rng.pick(SYLLABLES, ctx.name, *path, i) for i in range(parts)])


def _title(ctx: Context, *path: object, parts: int = 2) -> Column:
    return F.initcap(_word(ctx, *path, parts=parts))


def _luhn(digits: Column, n: int) -> Column:
    """Digits of a number of length n with their Luhn check digit."""
    total = F.lit(0)
    for i in range(n):
        d = F.substring(digits, i + 1, 1).cast("int")
        if (n - i) % 2 == 1:
            d = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        total = total + d
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def _ean(digits: Column) -> Column:
    total = sum((F.substring(digits, i + 1, 1).cast("int") * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def _iban(ctx: Context) -> Column:
    """A two-letter country, check digits by modulo 97, and 18 digits."""
    body = pattern(ctx, "##################")
    check = F.lit(98) - (F.concat(body, F.lit("131400")).cast("decimal(38,0)") % 97).cast("int")
    return F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), body)


#: Kinds of text by name. Names are made of syllables, so no word lists are needed.
FAKES: dict[str, Callable[[Context], Column]] = {
    "first_name": lambda c: _title(c, "first"), "last_name": lambda c: _title(c, "last", parts=3), "name": lambda c: F.concat_ws(" ", _title(c, "first"), _title(c, "last", parts=3)),
    "email": lambda c: F.concat(_word(c, "first"), F.lit("."), _word(c, "last", parts=3), F.lit("@"), c.rng.pick(DOMAINS, c.name, "domain")), "username": lambda c: F.concat(_word(c, "user"), c.rng.integer(1, 9999, c.name, "n").cast("string")),
    "phone": lambda c: pattern(c, "+1-###-###-####"), "city": lambda c: F.concat(_title(c, "city"), F.lit("ville")), "country": lambda c: c.rng.pick(COUNTRIES, c.name), "state": lambda c: _title(c, "state"),
    "street": lambda c: F.concat_ws(" ", _title(c, "street"), c.rng.pick(STREETS, c.name, "kind")), "address": lambda c: F.concat_ws(" ", c.rng.integer(1, 999, c.name, "n").cast("string"), _title(c, "street"), c.rng.pick(STREETS, c.name, "kind")),
    "zip": lambda c: pattern(c, "#####"), "company": lambda c: F.concat_ws(" ", _title(c, "company"), c.rng.pick(KINDS, c.name, "kind")), "job": lambda c: F.initcap(F.concat_ws(" ", c.rng.pick(WORDS, c.name, 1), F.lit("engineer"))),
    "word": lambda c: c.rng.pick(WORDS, c.name), "words": lambda c: F.concat_ws(" ", *[c.rng.pick(WORDS, c.name, i) for i in range(3)]), "sentence": lambda c: F.concat(F.initcap(c.rng.pick(WORDS, c.name, 0)), F.lit(" "), F.concat_ws(" ", *[c.rng.pick(WORDS, c.name, i) for i in range(1, 8)]), F.lit(".")),
    "paragraph": lambda c: F.concat_ws(" ", *[FAKES["sentence"](Context(c.seed, c.entity, f"{c.name}.{i}", c.rows, c.row, c.portable)) for i in range(3)]), "url": lambda c: F.concat(F.lit("https://"), _word(c, "host"), F.lit("."), c.rng.pick(DOMAINS, c.name, "domain"), F.lit("/"), c.rng.pick(WORDS, c.name, "path")),
    "domain": lambda c: F.concat(_word(c, "host"), F.lit("."), c.rng.pick(DOMAINS, c.name)), "ipv4": lambda c: F.concat_ws(".", *[c.rng.integer(1, 254, c.name, i).cast("string") for i in range(4)]), "ipv6": lambda c: F.concat_ws(":", *[F.lpad(F.lower(F.hex(c.rng.integer(0, 65535, c.name, i))), 4, "0") for i in range(8)]),
    "mac": lambda c: F.concat_ws(":", *[F.lpad(F.lower(F.hex(c.rng.integer(0, 255, c.name, i))), 2, "0") for i in range(6)]), "color": lambda c: F.concat(F.lit("#"), F.lpad(F.lower(F.hex(c.rng.integer(0, 0xFFFFFF, c.name))), 6, "0")), "uuid": uuid,
    "credit_card": lambda c: _luhn(F.concat(F.lit("4"), pattern(c, "##############")), 15), "ean13": lambda c: _ean(pattern(c, "############")), "isbn13": lambda c: _ean(F.concat(F.lit("978"), pattern(c, "#########"))), "iban": _iban, "ssn": lambda c: pattern(c, "9##-##-####"),
    "latitude": lambda c: F.round(c.uniform() * 180 - 90, 6), "longitude": lambda c: F.round(c.uniform() * 360 - 180, 6), "boolean": lambda c: c.uniform() < 0.5, "digit": lambda c: c.rng.integer(0, 9, c.name), "integer": lambda c: c.rng.integer(0, 1000, c.name), "float": lambda c: c.uniform() * 1000,
    "date": lambda c: F.date_add(F.lit("2020-01-01").cast("date"), c.rng.integer(0, 1825, c.name).cast("int")), "datetime": lambda c: F.timestamp_millis(F.lit(1577836800000) + (c.uniform() * 1825 * 86_400_000).cast("long")), "time": lambda c: c.rng.integer(0, 86_399_999, c.name),
    "currency": lambda c: c.rng.pick(["USD", "EUR", "GBP", "JPY", "CHF"], c.name), "product": lambda c: F.initcap(F.concat_ws(" ", c.rng.pick(WORDS, c.name, 1), c.rng.pick(WORDS, c.name, 2))), "sku": lambda c: pattern(c, "AAA-####"), "user_agent": lambda c: F.concat(_title(c, "agent"), F.lit("/"), c.rng.integer(1, 20, c.name, "v").cast("string"), F.lit(".0")),
    "file_name": lambda c: F.concat(c.rng.pick(WORDS, c.name, 1), F.lit("."), c.rng.pick(["txt", "csv", "pdf", "png"], c.name, "ext")), "mime": lambda c: c.rng.pick(["text/plain", "text/csv", "application/pdf", "image/png"], c.name), "hex": lambda c: F.substring(F.md5(F.concat(F.lit(f"{c.seed}|{c.name}|"), c.row.cast("string"))), 1, 16), "slug": lambda c: F.concat_ws("-", *[c.rng.pick(WORDS, c.name, i) for i in range(2)]),
}


#: Other names of kinds of text, and kinds that are picks from short lists.
ALIASES = {
    "full_name": "name", "prefix": "name_prefix", "suffix": "name_suffix", "ip_address": "ipv4", "mac_address": "mac", "street_address": "address", "city_name": "city", "zip_code": "zip", "zipcode": "zip", "postal_code": "zip", "catchphrase": "catch_phrase", "credit_card_number": "credit_card", "swift": "bic",
    "currency_code": "currency", "timestamp": "datetime", "weekday": "day_of_week", "tz": "timezone", "hex_color": "color", "extension": "file_extension", "mime_type": "mime", "content_type": "mime", "lat": "latitude", "lon": "longitude", "lng": "longitude", "geo": "coordinate", "plate": "license_plate", "make": "vehicle_make", "model": "vehicle_model",
    "isbn": "isbn13", "product_name": "product", "hex_string": "hex",
}
_LISTS = {
    "name_prefix": ["Mr.", "Ms.", "Mx.", "Dr.", "Prof."], "name_suffix": ["Jr.", "Sr.", "II", "III", "PhD"], "country_code": ["AT", "BR", "CA", "DE", "ES", "FR", "GB", "IN", "JP", "US"], "industry": ["Logistics", "Energy", "Retail", "Software", "Farming", "Media", "Mining", "Health"],
    "buzzword": ["scalable", "modular", "shared", "open", "mobile", "lean", "agile", "secure"], "month": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"], "day_of_week": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"],
    "timezone": ["UTC", "Europe/Berlin", "Europe/Paris", "America/New_York", "America/Lima", "Asia/Tokyo", "Asia/Kolkata", "Australia/Perth"], "file_extension": ["txt", "csv", "pdf", "png", "json", "xml"], "blood_type": ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"], "vehicle_make": ["Orvan", "Tessel", "Brumo", "Kadira", "Lunet"],
}
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"


def _vin(ctx: Context) -> Column:
    """Seventeen characters with the check digit of ISO 3779 in ninth place."""
    # weights of the places, and the value of each letter: fixed by the standard
    weights = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
    values = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ", [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9], strict=True)) | {str(d): d for d in range(10)}
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    signs = [ctx.rng.pick(list(VIN_LETTERS), ctx.name, i) for i in range(17)]
    check = sum((table[s] * w for s, w in zip(signs, weights, strict=True) if w), F.lit(0)) % 11
    signs[8] = F.when(check == 10, "X").otherwise(check.cast("string"))
    return F.concat(*signs)


FAKES |= {k: lambda c, v=v: c.rng.pick(v, c.name) for k, v in _LISTS.items()}
FAKES |= {
    "title": lambda c: F.initcap(F.concat_ws(" ", *[c.rng.pick(WORDS, c.name, i) for i in range(3)])), "catch_phrase": lambda c: F.initcap(F.concat_ws(" ", c.rng.pick(_LISTS["buzzword"], c.name, 1), c.rng.pick(WORDS, c.name, 2), c.rng.pick(WORDS, c.name, 3))),
    "bs": lambda c: F.concat_ws(" ", c.rng.pick(["grow", "build", "link", "shape"], c.name, 1), c.rng.pick(_LISTS["buzzword"], c.name, 2), c.rng.pick(WORDS, c.name, 3)), "bic": lambda c: F.concat(pattern(c, "AAAA"), c.rng.pick(_LISTS["country_code"], c.name, "country"), F.lit("2"), c.rng.pick(list("ABCDEFGH"), c.name, "place")),
    "coordinate": lambda c: F.concat_ws(", ", F.round(c.uniform("lat") * 180 - 90, 6).cast("string"), F.round(c.uniform("lon") * 360 - 180, 6).cast("string")), "file_path": lambda c: F.concat(F.lit("/"), F.concat_ws("/", *[c.rng.pick(WORDS, c.name, i) for i in range(2)]), F.lit("."), c.rng.pick(_LISTS["file_extension"], c.name, "ext")),
    "license_plate": lambda c: pattern(c, "AA-### AA"), "vin": _vin, "vehicle_model": lambda c: F.concat(_title(c, "model"), F.lit(" "), c.rng.integer(1, 9, c.name, "n").cast("string")),
}


@generator("faker")
def faker(ctx: Context, kind: str = "word") -> Column:
    kind = ALIASES.get(kind, kind)
    if kind not in FAKES:
        raise ValueError(f"unknown kind of text {kind}")
    return FAKES[kind](ctx)


def null_mask(ctx: Context, value: Column, rate: float = 0.0, every: int | None = None, own_rate: float = 0.0) -> Column:
    """Nulls in a share of rows, or in every n-th. A rate counts the nulls the values already have: own_rate of them."""
    if every:
        return F.when(ctx.row % every != every - 1, value)
    extra = (rate - own_rate) / (1 - own_rate) if own_rate < 1 else 0.0
    return F.when(ctx.uniform("null") >= max(0.0, extra), value) if extra > 0 else value
