"""Scalar functions over columns: prices, quantities, promotion mechanics, names, dates.

All are column expressions; none is a Python UDF.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED, PLAIN = "àáâäãèéêëìíîïòóôöõùúûüçñÀÁÂÄÃÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"
#: Units with the unit that they are measured in, how many of it they hold, and the unit of match keys (None: keys leave them).
UNITS = {
    "kg": ("kg", 1.0, "g"), "kilo": ("kg", 1.0, None), "g": ("kg", 0.001, "g"), "gr": ("kg", 0.001, None), "grammi": ("kg", 0.001, None),
    "hg": ("kg", 0.1, None), "etto": ("kg", 0.1, None), "etti": ("kg", 0.1, None),
    "l": ("L", 1.0, "ml"), "lt": ("L", 1.0, None), "litri": ("L", 1.0, None), "litro": ("L", 1.0, None), "ml": ("L", 0.001, "ml"), "cl": ("L", 0.01, "ml"), "dl": ("L", 0.1, "ml"),
    "pz": ("unit", 1.0, "pz"), "pezzi": ("unit", 1.0, None), "pezzo": ("unit", 1.0, None), "rotoli": ("unit", 1.0, None), "rotolo": ("unit", 1.0, None),
    "bustine": ("unit", 1.0, None), "fette": ("unit", 1.0, None),
}
#: Mechanics with the phrases that name them (# is a number), the discount in percent ("#": that number), and the confidence; the first that fits wins.
MECHANICS = [
    ("three_for_two", ["3x2", "prendi 3 paghi 2"], 33.3, 0.98),
    ("two_for_price_of_one", ["2x1", "prendi 2 paghi 1"], 50.0, 0.98),
    ("second_half_price", ["50% sul secondo", "secondo al 50%", "secondo 50%", "secondo pezzo al 50%", "secondo pezzo 50%"], 25.0, 0.95),
    ("loyalty_price", ["con carta", "carta fedeltà", "carta fedelta"], None, 0.95),
    ("sottocosto", ["sottocosto"], None, 0.99),
    ("percentage_off", ["-#%", "sconto #%", "sconto del #%"], "#", 0.95),
]
#: Tags with the parts of a name that give them.
TAGS = {
    "senza-lattosio": ["senza lattosio", "delattosato", "lactose free", "s.lattosio"],
    "senza-glutine": ["senza glutine", "gluten free", "s.glutine"],
    "integrale": ["integrale", "integrali"],
    "bio": ["biologic", "bio "],
    "vegano": ["vegan", "vegetale", "plant based", "plant-based"],
    "prima-infanzia": ["neonato", "bimbo", "pannolin", "omogenizz", "baby", "infanzia", "crescita"],
    "proteico": ["proteic", "protein"],
    "surgelati": ["surgelat", "congelat", "frozen"],
    "cura-casa": ["detersivo", "detergente", "ammorbidente", "sgrassator", "candeggina", "anticalcar", "lavastoviglie", "pavimenti", "carta igienica", "scottex", "sacchetti"],
    "cura-persona": ["shampoo", "balsamo", "bagnoschiuma", "dentifricio", "doccia", "crema", "deodorante", "rasoio", "assorbent", "sapone"],
}
#: Categories in order of precedence with the parts of a name that give them; \\b is the end of a word.
CATEGORY_PARTS = [
    ("latticini", ["latte", "yogurt", "formaggio", "ricotta", "mozzarella", "burrata", "parmigiano", "grana", "mascarpone", "stracchino"]),
    ("pasta", [r"pasta\b", "spaghett", "penne", "rigatoni", "fusilli", "farfalle", "orecchiette", "tagliatelle", "lasagn"]),
    ("panificati", ["pane", "grissini", "cracker", "fette biscottate", "pan bauletto", "focaccia"]),
    ("bevande-alcoliche", ["birra", "vino", "prosecco", "champagne", "lambrusco", "spumante", "aperol", "campari", "spritz"]),
    ("bevande", ["acqua", "succo", "aranciata", "cola", "limonata", "the ", "te "]),
    ("salumi", ["prosciutto", "salame", "mortadella", "bresaola", "speck", "pancetta", "wurstel", "salsiccia"]),
    ("carne", ["pollo", "manzo", "vitello", "maiale", "tacchino", "coniglio", "agnello", "hamburger", "carne"]),
    ("pesce", ["salmone", "tonno", "merluzzo", "pesce", "gamberi", "calamari", "cozze", "vongole"]),
    ("dolci-snack", ["biscotti", "cioccolat", "gelato", "torta", "merendina", "croissant", "brioche", "wafer", "snack"]),
    ("condimenti", ["olio", "aceto", "sale", "pepe", "sugo", "passata", "pelati", "pomodoro", "pesto", "condiment"]),
    ("cura-casa", ["detersivo", "detergente", "ammorbidente", "candeggina", "sgrassator", "carta igienica", "scottex"]),
    ("cura-persona", ["shampoo", "balsamo", "bagnoschiuma", "dentifricio", "sapone", "crema", "deodorant"]),
    ("surgelati", ["surgelat", "congela", "frozen"]),
    ("caffe-te", ["caffe", "caffè", "orzo", "camomilla"]),
    ("riso-cereali", [r"riso\b", "risotto", "arborio", "carnaroli", "basmati"]),
]
#: Italian words that a match key leaves out.
FILLERS = "il lo la i gli le un uno una di del dello della dei degli delle al allo alla ai agli alle da dal dallo dalla con su sul sullo sulla per in nel nello nella tra fra e o a".split()
#: Italian months.
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]
NUMBER = r"(\d+(?:[.,]\d+)?)"
def no_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def parse_price(text: Column) -> Column:
    """Price of a text: that of "da X,XX", else the first number, or null unless it lies between 0 and 10000.

    A dot before three digits and a comma or space is a thousands mark; the comma is the
    decimal mark.
    """
    t = F.regexp_replace(text, "[€$£]", "")
    since = number(F.regexp_extract(t, r"(?i)\bda\s+(\d+[.,]\d+)", 1))
    v = number(F.regexp_extract(F.regexp_replace(t, r"(?<=\d)\.(?=\d{3}[,\s])", ""), NUMBER, 1))
    return F.coalesce(since, F.when((v > 0) & (v < 10000), v))


def tokens(text: Column) -> Column:
    """Numbers, words and single signs of a text in lower case; the times sign is "x"."""
    return F.regexp_extract_all(F.translate(F.lower(text), "×", "x"), F.lit(r"\d+(?:[.,]\d+)?|\p{L}+|[^\s\p{L}\d]"), F.lit(0))


def _run(t: Column, *tests) -> Column:
    """The 0-based place of the first run of tokens that pass the tests one after the other, or null."""
    starts = F.when(F.size(t) >= len(tests), F.sequence(F.lit(0), F.size(t) - len(tests))).otherwise(F.array().cast("array<int>"))
    fits = lambda i: functools.reduce(lambda x, y: x & y, [test(F.get(t, i + k)) for k, test in enumerate(tests)])
    return F.get(F.filter(starts, fits), 0)


def _is_number(c: Column) -> Column:
    return c.rlike(r"^\d")


def _is_whole(c: Column) -> Column:
    return c.rlike(r"^\d+$")


def _is_unit(counted: bool):
    return lambda c: c.isin([u for u, (base, *_) in UNITS.items() if (base == "unit") == counted])


def _is(*words: str):
    return lambda c: c.isin(*words)


def _of_unit(unit: Column, which: int) -> Column:
    return F.create_map(*[x for u, v in UNITS.items() for x in (F.lit(u), F.lit(v[which]))])[unit]


def parse_quantity(text: Column) -> Column:
    """Struct (value, unit, base_unit, base_value, confidence): packs in any order, one measure, pieces, "conf da N".

    The base units are kg, L and unit; a pack's value is the sum of its items.
    """
    t = tokens(text)
    times, measure = _is("x"), _is_unit(False)

    def made(value: Column, unit: Column, base: Column, of_base: Column, sure: float) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit"), base.alias("base_unit"), (value * of_base).alias("base_value"), F.lit(sure).alias("confidence")))

    def measured(value: Column, unit: Column, sure: float) -> Column:
        return made(value, unit, _of_unit(unit, 0), _of_unit(unit, 1), sure)

    at = lambda i, k: F.get(t, i + k)
    pack, swapped, plain = _run(t, _is_whole, times, _is_number, measure), _run(t, _is_number, measure, times, _is_whole), _run(t, _is_number, measure)
    pieces, boxed = _run(t, _is_whole, _is_unit(True)), _run(F.filter(t, lambda w: w != "."), _is("conf", "confezione"), _is("da"), _is_whole)
    one = F.lit("unit")
    return F.coalesce(
        measured(number(at(pack, 0)) * number(at(pack, 2)), at(pack, 3), 0.9),
        measured(number(at(swapped, 0)) * number(at(swapped, 3)), at(swapped, 1), 0.9),
        measured(number(at(plain, 0)), at(plain, 1), 0.95),
        made(number(at(pieces, 0)), one, one, F.lit(1.0), 0.9),
        made(number(F.get(F.filter(t, lambda w: w != "."), boxed + 2)), one, one, F.lit(1.0), 0.8),
    )


def _phrase(phrase: str) -> str:
    """The pattern of a phrase in a text of tokens that are parted by blanks."""
    found = re.findall(r"\d+|[^\W\d]+|[^\s\w]", phrase.replace("×", "x"))
    return "(?<= )" + " ".join(r"(\d+)" if w == "#" else re.escape(w) for w in found) + "(?= )"


def parse_mechanic(text: Column, rebate: Column | None = None) -> Column:
    """Struct (mechanic, detail, discount, confidence) of a text and a rebate's text, by the table of phrases.

    Phrases are compared by tokens, so blanks and letter case do not matter; the detail is
    the phrase found.  A percentage alone counts in the rebate only.
    """
    rebate = F.lit(None).cast("string") if rebate is None else rebate
    line = lambda c: F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(c, F.lit(""))), " "), F.lit(" "))
    t = line(F.concat_ws(" ", text, rebate))
    made = lambda name, detail, pct, sure: F.struct(F.lit(name).alias("mechanic"), detail.alias("detail"), pct.cast("double").alias("discount"), F.lit(sure).alias("confidence"))
    bare = F.regexp_extract(line(rebate), _phrase("#%"), 1)
    out = F.when(bare != "", made("percentage_off", bare, bare.try_cast("int"), 0.8)).otherwise(made("price_cut", F.lit(""), F.lit(None), 0.7))
    for name, phrases, pct, sure in reversed(MECHANICS):
        pattern = "|".join(map(_phrase, phrases))
        value = F.lit(pct)
        if pct == "#":
            value = F.coalesce(*[F.nullif(F.regexp_extract(t, pattern, i), F.lit("")) for i in range(1, len(phrases) + 1)]).try_cast("int")
        out = F.when(t.rlike(pattern), made(name, F.regexp_extract(t, pattern, 0), value, sure)).otherwise(out)
    return out


def unit_price(price: Column, base_value: Column, given: Column | None = None) -> Column:
    """Price for a base unit (kg, L or piece) to four decimals, null unless the quantity is positive; a given one wins."""
    computed = F.when(base_value > 0, F.round(price / F.nullif(base_value, F.lit(0.0)), 4))
    return F.coalesce(given, computed) if given is not None else computed


def discount(parsed: Column, mechanic: Column, price: Column, original: Column) -> Column:
    """The parser's discount, else the mechanic's, else from the prices if they fall; null unless it lies between 0 and 90.

    The bounds hold for the value that the cascade gives: one out of bounds does not fall to the next.
    """
    computed = F.when(price < original, F.round((1 - price / F.nullif(original, F.lit(0.0))) * 100))
    found = F.coalesce(parsed.cast("double"), mechanic.cast("double"), computed)
    return F.when((found > 0) & (found < 90), found)


def clean_ean(*cols: Column) -> Column:
    """The first value with 8 to 14 digits."""
    digits = [F.regexp_replace(c, r"\D", "") for c in cols]
    return F.coalesce(*[F.when(F.length(x).between(8, 14), x) for x in digits])


def card_name(chain: Column, card: Column, mechanic: Column) -> Column:
    """The card's name without the chain's in front, for loyalty prices."""
    return F.when(mechanic == "loyalty_price", F.trim(F.regexp_replace(card, F.concat(F.lit(r"(?i)^\s*\Q"), chain, F.lit(r"\E\s*")), F.lit(""))))


def raw_quantity(c: Column) -> Column:
    units = "|".join(u for u in UNITS if len(u) <= 2)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), rf"(?i)(?<=\d)\s*(?=(?:{units})\b)", " ")))


def norm_text(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.trim(c), r"[\s ]+", " ")), F.lit(""))


def match_key(brand: Column, name: Column, quantity: Column) -> Column:
    """brand | name without the brand at its ends, fillers, accents and marks | quantity.

    "pasta di semola (di grano duro)" goes, "n. 5" becomes "n5".
    """
    b, n = F.lower(F.trim(F.coalesce(brand, F.lit("")))), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    # plain string functions: a pattern that differs from row to row would be compiled for each
    front = (b != "") & n.startswith(F.concat(b, F.lit(" ")))
    n = F.when(front, F.ltrim(F.substr(n, F.length(b) + 2))).otherwise(n)
    back = (b != "") & n.endswith(F.concat(F.lit(" "), b))
    n = F.when(back, F.rtrim(F.left(n, F.length(n) - F.length(b) - 1))).otherwise(n)
    n = F.regexp_replace(n, rf"\b({'|'.join(FILLERS)})\b", " ")
    n = F.regexp_replace(n, r"pasta\s+semola(\s+grano\s+duro)?\s*", "")
    n = no_accents(F.regexp_replace(n, r"n[.°]\s*(\d+)", "n$1"))
    n = F.trim(F.regexp_replace(F.regexp_replace(n, r"""[,;:!?'"()\[\]{}]""", " "), r"\s+", " "))
    return F.concat_ws("|", no_accents(b), n, F.coalesce(normalize_quantity(quantity), F.lit("")))


def normalize_quantity(c: Column) -> Column:
    """Quantity as text in g, ml or pz like "1500 ml"; packs as "2x100 g"; other texts in lower case.

    Units of match keys are parted from their number by one blank, a first comma is a decimal mark.
    """
    keyed = [u for u, (*_, key) in UNITS.items() if key]
    unit_next = rf"(?:{'|'.join(keyed)})\b"
    text = F.regexp_replace(F.lower(F.trim(c)), rf"(?<=\d)\s*(?={unit_next})", " ")
    text = F.regexp_replace(text, r"^([^,]*),", "$1.")
    t = tokens(text)
    single = (F.size(t) == 2) & _is_number(F.get(t, 0)) & F.get(t, 1).isin(keyed)
    unit = F.get(t, 1)
    small = _of_unit(unit, 2)
    value = number(F.get(t, 0)) * F.when(small == "pz", 1.0).otherwise(_of_unit(unit, 1) * 1000)
    plain = F.regexp_replace(value.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    return F.when(single, F.concat_ws(" ", plain, small)).otherwise(F.regexp_replace(text, rf"(?<=\d)\s*x\s*(?=\d+\s*{unit_next})", "x"))


def slugify(c: Column, most: int = 120) -> Column:
    s = F.regexp_replace(F.regexp_replace(no_accents(F.lower(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.substring(s, 1, most)


def infer_category(name: Column, rules: Sequence[tuple[str, Sequence[str]]] = tuple(CATEGORY_PARTS), default: str = "altro") -> Column:
    """The category of the first rule of which a part occurs anywhere in the name."""
    text, out = F.lower(name), F.lit(default)
    for slug, parts in reversed(rules):
        out = F.when(text.rlike("|".join(parts)), slug).otherwise(out)
    return out


def dietary_tags(c: Column, tags: dict[str, Sequence[str]] | None = None) -> Column:
    """All tags of which a part occurs in the name, in the order of the table; "bio" may also end it."""
    text = F.concat(F.lower(c), F.lit(" "))
    has = lambda parts: functools.reduce(lambda x, y: x | y, [F.contains(text, F.lit(p)) for p in parts])
    return F.array_compact(F.array(*[F.when(has(parts), F.lit(t)) for t, parts in (tags or TAGS).items()]))


def week_start(c: Column) -> Column:
    return F.to_date(F.date_trunc("week", c))


def current_week(c: Column) -> Column:
    """Struct of the Monday and Sunday around a day."""
    return F.struct(week_start(c).alias("monday"), F.date_add(week_start(c), 6).alias("sunday"))


def month_number(c: Column) -> Column:
    return functools.reduce(lambda out, i: F.when(F.substring(F.lower(c), 1, 3) == MONTHS[i][:3], i + 1).otherwise(out), range(12), F.lit(None).cast("int"))


def italian_range(text: Column, year: Column) -> Column:
    """Struct (valid_from, valid_to) of an Italian date range; a missing year is ``year``.

    "dal 17 al 29 aprile 2026", "dal 28 aprile al 4 maggio", "dal 1/4 al 30/4",
    "fino al 19 aprile", "17APR_29APR" and "01.04 - 30.04".
    """
    t = F.lower(F.regexp_replace(text, r"[\s ]+", " "))
    get = lambda p, i: F.regexp_extract(t, p, i)
    month = "(gen|feb|mar|apr|mag|giu|lug|ago|set|ott|nov|dic)[a-z]*"
    day_ = lambda y, m, d: F.when(m.between(1, 12) & d.between(1, 31), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))
    num = lambda c: c.try_cast("int")
    yr = lambda c: F.coalesce(num(c), year)
    both = lambda a, b: F.when(b.isNotNull(), F.struct(a.alias("valid_from"), b.alias("valid_to")))
    same, two, slash, until, short = rf"da(?:l)? (?:[a-zì]+ )?(\d{{1,2}}) a(?:l)? (?:[a-zì]+ )?(\d{{1,2}}) {month}(?: (\d{{4}}))?", rf"da(?:l|ll')? ?(\d{{1,2}}) {month} a(?:l|ll')? ?(\d{{1,2}}) {month}(?: (\d{{4}}))?", r"(\d{1,2})[/.](\d{1,2})(?:[/.](\d{4}))?\s*(?:al|-|–)\s*(\d{1,2})[/.](\d{1,2})(?:[/.](\d{4}))?", rf"fino al (\d{{1,2}}) {month}(?: (\d{{4}}))?", rf"(\d{{1,2}}){month}_(\d{{1,2}}){month}"
    none = F.lit(None).cast("date")
    return F.coalesce(
        both(day_(yr(get(two, 5)), month_number(get(two, 2)), num(get(two, 1))), day_(yr(get(two, 5)), month_number(get(two, 4)), num(get(two, 3)))),
        both(day_(yr(get(same, 4)), month_number(get(same, 3)), num(get(same, 1))), day_(yr(get(same, 4)), month_number(get(same, 3)), num(get(same, 2)))),
        both(day_(yr(get(slash, 3)), num(get(slash, 2)), num(get(slash, 1))), day_(yr(get(slash, 6)), num(get(slash, 5)), num(get(slash, 4)))),
        both(none, day_(yr(get(until, 3)), month_number(get(until, 2)), num(get(until, 1)))),
        both(day_(year, month_number(get(short, 2)), num(get(short, 1))), day_(year, month_number(get(short, 4)), num(get(short, 3)))),
    )


def compact_date(c: Column) -> Column:
    """The day of a time stamp YYYYMMDDHHMMSS, of which eight digits at least must be there."""
    return F.try_to_date(F.regexp_extract(F.trim(c), r"^(\d{8})\d*$", 1), "yyyyMMdd")


def split_brand(name: Column, brands: Sequence[str]) -> Column:
    """Struct (brand, rest): a known brand in front (longest first), else leading capitals, else a known brand at the end."""
    known = "|".join("\\Q" + b + "\\E" for b in sorted(brands, key=lambda b: (-len(b), b))) or r"(?!)"
    front, caps, back = rf"(?i)^({known})\b\s*", r"^((?:[A-Z][A-Z&'.]+\s+)+)(?=\S)", rf"(?i)\s+({known})$"
    made = lambda p: F.struct(F.trim(F.regexp_extract(name, p, 1)).alias("brand"), F.trim(F.regexp_replace(name, p, "")).alias("rest"))
    return F.when(name.rlike(front), made(front)).when(name.rlike(caps), made(caps)).when(name.rlike(back), made(back)).otherwise(F.struct(F.lit(None).cast("string").alias("brand"), F.trim(name).alias("rest")))


def split_size(name: Column) -> Column:
    """Struct (name, size): the size at the end of a name taken off."""
    p = rf"(?i)\s+((?:\d+\s*x\s*)?{NUMBER}\s*(?:{'|'.join(u for u in UNITS if len(u) <= 2)}))\.?$"
    return F.struct(F.trim(F.regexp_replace(name, p, "")).alias("name"), F.nullif(F.regexp_extract(name, p, 1), F.lit("")).alias("size"))


def ip_hash(ip: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(ip, F.lit(salt)), 256), 1, 16)


def encrypt(c: Column, key: Column) -> Column:
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def decrypt(c: Column, key: Column) -> Column:
    """Plain text of an encrypted column; values that are not encrypted come back as they are."""
    raw = F.expr("try_to_binary(NULL)") if c is None else F.when(c.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(c) % 4 == 0) & (F.length(c) >= 40), F.unbase64(c))
    return F.coalesce(F.try_aes_decrypt(raw, key, F.lit("GCM")).cast("string"), c)


def alert_text(name: Column, chain: Column, cents: Column, pct: Column, until: Column) -> Column:
    return F.concat_ws(" ", name, F.concat(F.lit("@ "), chain), F.concat((cents / 100).cast("decimal(12,2)").cast("string"), F.lit(" EUR")), F.concat(F.lit("-"), pct.cast("string"), F.lit("%")), F.concat(F.lit("fino al "), F.date_format(until, "dd/MM/yyyy")))


def maps_link(lat: Column, lng: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/maps?q="), lat.cast("string"), F.lit(","), lng.cast("string"))


def image_search_link(*words: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/search?tbm=isch&q="), F.url_encode(F.concat_ws(" ", *words)))
