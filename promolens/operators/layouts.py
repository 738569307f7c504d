"""Two flyer layouts that simple patterns cannot cut: line blocks under a pair of prices, and prices with their text before them.

Both work on a table of documents (doc_id, text), a page each, with built-in functions.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import number
from .offers import first_per

# ---- blocks under a pair of prices -------------------------------------------------------

#: The lines of a page by kind; the first pattern that fits names the kind.
BLOCK_LINES = {
    "slash": r"^/$",
    "price": r"^(\d+,\d{2})$",
    "each": r"^cad\.\s+(\d+,\d{2})(?:\s+\d+,\d{2})?$",
    "unit": r"^al\s+(kg|litro|l|pezzo|pz)\s+euro\s+(\d+,\d{2})(?:\s+(\d+,\d{2}))?$",
    "loose": r"^al\s+(kg|litro|l|pezzo|pz)$",
    "weight": r"^(?:\d+(?:[.,]\d+)?|\d+\s*x\s*\d+)\s*(?:g|kg|ml|cl|dl|l|pz)\b",
    "noise": r"^(?:cad\.$|scarica l|la spesa intelligente|eurospin)",
}
#: Names with these parts, and names that start so, are no products.
NO_PRODUCT, NO_START = ["hotel", "viaggio", "vacanz"], ["Prodotto Per", "Semi -", "Misura -", "Sole -"]


def extract_price_blocks(docs: DataFrame, most_lines: int = 18, shortest: int = 5, text: str = "text") -> DataFrame:
    """Products of pages on which a pair of prices and "/" opens a block of lines.

    Gives doc_id, pos (of the block's first line), name, offer, original, unit_price, unit,
    quantity, discount.  A block opens at two prices (or a price and "cad. price") and "/",
    the lower price being the offer.  A line for the price of a unit, or a weight, closes
    it; a price behind it is the next block's offer, which then needs its original price
    and "/" alone.  Other prices close a block too, and so does its ``most_lines``-th line.
    Lines between blocks belong to none.  Documents with a null id or text have no
    products; a repeated id must not occur.
    """
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("pos", "line"))
    low, kind = F.lower("line"), F.lit("text")
    for name, pattern in reversed(BLOCK_LINES.items()):
        kind = F.when(low.rlike(pattern), name).otherwise(kind)
    group = lambda name, i: F.nullif(F.regexp_extract(low, BLOCK_LINES[name], i), F.lit(""))
    lines = lines.withColumn("kind", kind)
    behind = F.regexp_extract("line", r"\s(\d+,\d{2})$", 1)  # a price at the end of a weight
    heavy = (F.col("kind") == "weight") & (behind != "")
    own = number(F.coalesce(group("price", 1), group("each", 1)))
    lines = lines.withColumns({"price": F.when(F.col("kind").isin("price", "each"), own), "carry": F.when(F.col("kind") == "unit", number(group("unit", 3))).when(heavy, number(behind)), "closes": (F.col("kind") == "unit") | heavy})
    page = Window.partitionBy("doc_id").orderBy("pos")
    ahead = lambda c, n: F.lead(c, n).over(page)
    priced = lambda c: c.isin("price", "each")
    pair = (F.col("kind") == "price") & priced(ahead("kind", 1)) & (ahead("kind", 2) == "slash")
    # with an offer from the line before, the original price is enough
    single = priced(F.col("kind")) & (ahead("kind", 1) == "slash") & F.lag("carry").over(page).isNotNull()
    lines = lines.withColumns({"pair": F.coalesce(pair, F.lit(False)), "single": F.coalesce(single & ~pair, F.lit(False)), "second": ahead("price", 1), "before": F.lag("carry").over(page)})
    # a price pair's own lines cannot open a block again
    lines = lines.withColumn("single", F.col("single") & ~F.coalesce(F.lag("pair").over(page), F.lit(False)))
    start = F.col("pair") | F.col("single")
    so_far = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"block": F.sum(start.cast("int")).over(so_far), "chain": F.sum(F.col("pair").cast("int")).over(so_far)}).where("block > 0")
    inside = Window.partitionBy("doc_id", "block").orderBy("pos")
    lines = lines.withColumns({"head": F.when(F.first("pair").over(inside), 3).otherwise(2), "at": F.row_number().over(inside)})
    lines = lines.withColumn("at", F.col("at") - F.col("head"))  # 1 is the first line of the body
    # the first line that ends the body: in it if it closes, before it if it is a stray price
    end = F.min(F.when((F.col("at") >= 1) & (F.col("closes") | (F.col("kind") == "price")), F.col("at"))).over(Window.partitionBy("doc_id", "block"))
    lines = lines.withColumn("end", F.coalesce(end, F.lit(1 << 30)))
    size = F.max("at").over(Window.partitionBy("doc_id", "block"))
    # an offer carried over counts if the block before was open up to its last line
    whole = (F.col("end") == size) & (F.col("end") <= most_lines) & F.last("closes").over(Window.partitionBy("doc_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lines = lines.withColumn("whole", F.coalesce(whole, F.lit(False)))
    lines = lines.where((F.col("at") <= F.least("end", F.lit(most_lines))) & ~((F.col("at") == F.col("end")) & ~F.col("closes")))
    body = lambda ok, value: F.transform(F.array_sort(F.collect_list(F.when((F.col("at") >= 1) & ok, F.struct("pos", value.alias("v"))))), lambda x: x["v"])
    first = F.col("at") == 1 - F.col("head")
    unit = F.when(group("unit", 1) == "kg", "kg").when(group("unit", 1).isin("l", "litro"), "litro").otherwise("pezzo")
    weight = F.when(heavy, F.trim(F.regexp_replace("line", r"\s\d+,\d{2}$", ""))).otherwise(F.col("line"))
    blocks = lines.groupBy("doc_id", "block").agg(
        F.min("pos").alias("pos"), F.min("chain").alias("chain"), F.max("whole").alias("whole"), F.max(F.when(first, F.col("pair"))).alias("pair"), F.max(F.when(first, F.col("price"))).alias("p1"),
        F.max(F.when(first, F.col("second"))).alias("p2"), F.max(F.when(first, F.col("before"))).alias("before"), body(F.col("kind").isin("text", "each"), F.col("line")).alias("names"),
        body(F.col("kind") == "weight", weight).alias("weights"), body(F.col("kind") == "loose", F.col("line")).alias("loose"), F.min(F.when((F.col("at") >= 1) & (F.col("kind") == "loose"), F.col("at"))).alias("loose_at"),
        F.min(F.when((F.col("at") >= 1) & (F.col("kind") == "weight"), F.col("at"))).alias("weight_at"), F.max(F.when((F.col("at") >= 1) & (F.col("kind") == "unit"), number(group("unit", 2)))).alias("unit_price"),
        F.max(F.when((F.col("at") >= 1) & (F.col("kind") == "unit"), unit)).alias("unit"))
    # blocks with a carried offer follow a pair block without a gap, each after a whole one
    run = Window.partitionBy("doc_id", "chain").orderBy("block")
    valid = F.min(F.when(F.col("pair"), True).otherwise(F.lag("whole").over(run))).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumn("valid", F.lag("whole").over(run)).withColumn("valid", F.min(F.when(F.col("pair"), True).otherwise(F.coalesce("valid", F.lit(False)))).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("valid")
    offer = F.when(F.col("pair"), F.least("p1", "p2")).otherwise(F.col("before"))
    original = F.when(F.col("pair"), F.greatest("p1", "p2")).otherwise(F.when(F.col("p1") > F.col("before"), F.col("p1")))
    early = F.col("loose_at").isNotNull() & (F.col("weight_at").isNull() | (F.col("loose_at") < F.col("weight_at")))
    quantity = F.array_join(F.concat(F.when(early, F.slice("loose", 1, 1)).otherwise(F.array().cast("array<string>")), F.col("weights")), " x ")
    name = F.trim(F.regexp_replace(F.regexp_replace(F.array_join("names", " "), r"\s+", " "), r"\s*,\s*$", ""))
    out = blocks.select("doc_id", "pos", name.alias("name"), offer.alias("offer"), original.alias("original"), "unit_price", "unit", F.nullif(quantity, F.lit("")).alias("quantity"))
    out = out.withColumn("discount", F.when(F.col("original") > F.col("offer"), F.round((1 - F.col("offer") / F.col("original")) * 100).cast("int")))
    bad = functools.reduce(lambda a, b: a | b, [*(F.contains(F.lower("name"), F.lit(x)) for x in NO_PRODUCT), *(F.col("name").startswith(x) for x in NO_START)])
    return out.where((F.length("name") >= shortest) & ~bad)


# ---- passes over prices, in order of priority ---------------------------------------------

EURO = r"(\d+[.,]\d{2})"


@dataclass
class Pass:
    """An anchor and the groups that hold what it tells (0: not told); ``unit_is_price`` where the price is that of a unit."""

    anchor: str
    price: int = 0
    original: int = 0
    discount: int = 0
    unit: int = 0
    unit_price: int = 0
    context: int = 500
    fixed_unit: str | None = None
    with_quantity: bool = True


@dataclass
class PassRules:
    """Which lines before an anchor are a product's.

    ``stop`` lines end the walk back, ``skip`` lines are left out, ``noise`` are starts of
    lines that end it.  All are compared without letter case.
    """

    passes: Sequence[Pass]
    noise: Sequence[str] = ()
    stop: Sequence[str] = ()
    skip: Sequence[str] = ()
    skip_lines: Sequence[str] = ()
    not_brand: Sequence[str] = ()
    no_name: Sequence[str] = ()
    quantity: str = r"\d+(?:[.,]\d+)?\s*(?:kg|g|ml|cl|dl|l|pz)\b"
    lines: int = 12
    least_discount: int = 5
    most_discount: int = 60
    badges: Sequence[str] = field(default_factory=tuple)


#: The rules of a flyer with prices below its products.
PRICE_BELOW = PassRules(
    passes=[
        Pass(rf"{EURO}\s*€\s*(?:(?:anziché\s+)?€/(kg|l)\s*{EURO}\s*)?-(\d+)\s*%\s*€\s*{EURO}", price=1, unit=2, unit_price=3, discount=4, original=5),
        Pass(rf"(?i)anziché\s+€/(?:kg|l)\s+{EURO}\s+{EURO}\s*€\s*€/(kg|l)\s+{EURO}\s*-(\d+)\s*%\s*€\s*{EURO}", price=2, unit=3, unit_price=4, discount=5, original=6),
        Pass(rf"{EURO}\s*€\s*(?:/conf)?\s*€/(kg|l)\s+{EURO}", price=1, unit=2, unit_price=3),
        Pass(rf"(?i){EURO}\s*€?\s*\nal\s+kg", price=1, context=400, fixed_unit="kg", with_quantity=False),
        Pass(r"(?i)(\d{2})\s*\n\s*SCONTO\s*%", discount=1, context=400),
        Pass(rf"\n{EURO}\s*\n€/(kg|l)\s+{EURO}", price=1, unit=2, unit_price=3),
        Pass(r"\n(\d{1,2})%\s*\n", discount=1, context=400),
    ],
    stop=[r"\d+[.,]\d{2}\s*€", r"€\s*\d+[.,]\d{2}", r"-\d+\s*%", r"\d{1,2}\s*sconto", r"sconto\s*%", r"al\s+kg\s*$", r"€/(?:kg|l)\s+\d+", r"anziché", r"\d{1,2}%$"],
    skip=[r"\d{1,2}$", r"(?:da|dal|fino\s+a)\s+(?:lun|mart|merc|giov|ven|sab|dom|\d{1,2})\S*\s+.*\s+(?:genn|feb|mar|apr|mag|giu|lug|ago|set|ott|nov|dic)", r"(?:solo\s+)?titolari$", r"(?:offerta\s+)?riservata$", r"carta\s*insieme$", r"per\s+te$"],
    noise=["supermerca", "le migliori marche", "offerta valida", "per gli orari", "consultare il sito", "centro commerciale", "scopri", "punto", "punti", "e pagando con", "carta insieme", "i punti indicati", "risparmio garantito", "bucato e", "regolamento", "guarda i volantini", "la merce è disponibile", "l'iniziativa è valida", "i prezzi possono"],
    skip_lines=["LATTE ITALIANO", "PRODOTTO ITALIANO", "CARNE ITALIANA", "POLLO ITALIANO", "BROCCOLI ITALIANI", "POMODORO ITALIANO", "OFFERTA RISERVATA", "ANCORA PIÙ CONVENIENTE", "QUESTO PRODOTTO TI REGALA", "SCELTE DI BENESSERE", "IL BUONO DEL PAESE", "PERCORSO QUALITÀ"],
    not_brand=[r"(?:senza|con|di|del|della|al|alla|per|dop|igp|doc|bio)\s", r"^rossi\s+e\s+gialli$", r"^bianco\s+e\s+rosso$", r"^italian[aieo]$", r"^fresch[ie]$", r"^classic[io]$", r"^(?:gusti|tipi)\s+assortiti$", r"^misti$", r"^piccante$", r"^dolce$", r"^naturale$", r"^biologic[oa]$"],
    no_name=["hotel", "viaggio", "vacanz", "concorso", "collare", "lettiera", "rimborsiamo", "soddisfatt"],
    badges=["LATTE", "BROCCOLI", "POMODORO", "PRODOTTO", "CARNE", "POLLO"],
)


def _matches(text: Column, p: Pass) -> Column:
    """Array of (context, groups...) of the pass's anchors in order; contexts end where the anchor starts."""
    told = {n: getattr(p, n) for n in ("price", "original", "discount", "unit", "unit_price")}
    anchors = F.regexp_extract_all(text, F.lit(p.anchor), F.lit(0))
    lengths = F.transform(F.split(text, p.anchor, -1), lambda x: F.length(x))
    size = F.size(anchors)

    def one(i: Column) -> Column:
        before = F.aggregate(F.slice(lengths, 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(anchors, 1, i), F.lit(0), lambda a, x: a + F.length(x))
        context = F.substring(text, F.greatest(before - p.context + 1, F.lit(1)), F.least(before, F.lit(p.context)))
        groups = [F.nullif(F.regexp_extract(F.get(anchors, i), p.anchor, g), F.lit("")).alias(n) if g else F.lit(None).cast("string").alias(n) for n, g in told.items()]
        return F.struct(i.alias("pos"), context.alias("context"), *groups)

    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), one))


def _walk(context: Column, rules: PassRules) -> Column:
    """Struct (lines in reading order, quantity): the lines before an anchor that are a product's."""
    lines = F.reverse(F.filter(F.transform(F.split(context, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    starts = lambda line, parts: line.rlike("(?i)^(?:" + "|".join(parts) + ")") if parts else F.lit(False)
    words = ["\\Q" + x + "\\E" for x in rules.noise]
    empty = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("quantity"))

    def step(s: Column, line: Column) -> Column:
        over = s["done"] | (F.size(s["lines"]) >= rules.lines) | starts(line, [*words, *rules.stop])
        left_out = F.upper(line).isin(list(rules.skip_lines)) | starts(line, list(rules.skip))
        amount = F.nullif(F.trim(F.regexp_extract(line, f"(?i){rules.quantity}(?:\\s*x\\s*\\d+)?", 0)), F.lit(""))
        alone = s["quantity"].isNull() & amount.isNotNull() & (F.length(F.trim(F.replace(line, amount, F.lit("")))) < 3)
        taken = F.struct(F.lit(False).alias("done"), F.when(alone, s["lines"]).otherwise(F.concat(F.array(line), s["lines"])).alias("lines"), F.coalesce(s["quantity"], amount).alias("quantity"))
        ended = F.struct(F.lit(True).alias("done"), s["lines"].alias("lines"), s["quantity"].alias("quantity"))
        return F.when(over, ended).when(left_out, s).otherwise(taken)

    return F.aggregate(lines, empty, step)


def _named(walked: Column, rules: PassRules) -> Column:
    """Struct (name, brand) from the leading lines in capitals; the last of several is the brand if it looks like one."""
    capital = lambda line: (line == F.upper(line)) & line.rlike("[A-Z]")
    state = F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("lines"))

    def step(s: Column, line: Column) -> Column:
        goes_on = s["open"] & capital(line) & ((F.size(s["lines"]) == 0) | ~line.endswith(","))
        return F.struct(goes_on.alias("open"), F.when(goes_on, F.concat(s["lines"], F.array(line))).otherwise(s["lines"]).alias("lines"))

    lines = F.aggregate(walked["lines"], state, step)["lines"]
    last, before = F.get(lines, F.size(lines) - 1), F.get(lines, F.size(lines) - 2)
    is_brand = (F.size(lines) >= 2) & last.rlike(r"^[A-Z][A-Z.&'\s]{1,30}$") & ~before.rlike("[/,-]$")
    if rules.not_brand:
        is_brand = is_brand & ~last.rlike("(?i)" + "|".join(rules.not_brand))
    kept = F.when(is_brand, F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    name = F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))
    return F.struct(name.alias("name"), F.when(is_brand, last).alias("brand"))


def extract_by_passes(docs: DataFrame, rules: PassRules = PRICE_BELOW, text: str = "text") -> DataFrame:
    """Products by anchors in order of priority; the first pass that claims a name at a price wins, then the first place.

    Gives doc_id, pass (from 1), pos, name, brand, quantity, offer, original, discount,
    unit_price, unit.  A product is read backwards from its anchor by the rules.  A pass
    without a price claims a name at its discount, and only discounts within the bounds.
    Documents with a null id or text have none.
    """
    cleaned = F.col(text)
    if rules.badges:
        # a badge of two lines between prices
        cleaned = F.regexp_replace(cleaned, rf"(?i)\n\s*(?:{'|'.join(rules.badges)})\s*\n\s*italian[oai]\s*\n", "\n")
    pages = docs.where(F.col("doc_id").isNotNull()).select("doc_id", cleaned.alias("__text"))
    numbered = lambda found, k: F.transform(found, lambda m: m.withField("pass", F.lit(k)))
    found = [numbered(_matches(F.col("__text"), p), k) for k, p in enumerate(rules.passes, 1)]
    rows = pages.select("doc_id", F.explode(F.concat(*[F.coalesce(x, F.array().cast(_TYPE)) for x in found])).alias("m"))
    kind = F.col("m.pass")
    rows = rows.withColumn("walked", _walk(F.col("m.context"), rules)).withColumn("named", _named(F.col("walked"), rules))
    setting = lambda name: F.get(F.array(*[F.lit(getattr(p, name)) for p in rules.passes]), kind - 1)
    price, unit_price = number(F.col("m.price")), number(F.col("m.unit_price"))
    unit = F.when(F.lower("m.unit") == "kg", "kg").when(F.lower("m.unit") == "l", "litro").otherwise(setting("fixed_unit"))
    out = rows.select(
        "doc_id", kind.alias("pass"), F.col("m.pos").alias("pos"), F.col("named.name").alias("name"), F.col("named.brand").alias("brand"), F.when(setting("with_quantity"), F.col("walked.quantity")).alias("quantity"),
        price.alias("offer"), number(F.col("m.original")).alias("original"), F.col("m.discount").try_cast("int").alias("discount"), F.when(setting("fixed_unit").isNotNull(), price).otherwise(unit_price).alias("unit_price"), unit.alias("unit"))
    priced = F.col("offer").isNotNull() | F.col("discount").between(rules.least_discount, rules.most_discount)
    bad = F.lower("name").rlike("|".join(rules.no_name)) if rules.no_name else F.lit(False)
    out = out.where((F.length("name") >= 3) & priced & ~bad)
    claim = F.coalesce(F.col("offer").cast("string"), F.concat(F.lit("discount "), F.col("discount").cast("string")))
    return first_per(out, ["doc_id", "name", claim], [F.col("pass"), F.col("pos")])


_TYPE = "array<struct<pos:int,context:string,price:string,original:string,discount:string,unit:string,unit_price:string,pass:int>>"
