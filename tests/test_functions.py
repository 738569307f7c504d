"""Vectors for scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from promolens.functions import scalars as fn
from promolens.functions import similarity as sm


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, price", [("€ 1,99", 1.99), ("da 2,50 €", 2.5), ("1.299,00", 1299.0), ("1.299", 1.299), ("0", None), ("Prezzo 1,99", 1.99), ("solo oggi 1.299,50 €", 1299.5), ("gratis", None), ("10000", None), (None, None), ("", None)])
def test_price(spark, text, price):
    assert one(spark, fn.parse_price(F.lit(text).cast("string"))) == price


@pytest.mark.parametrize("text, base, value", [("2x125 g", "kg", 0.25), ("500 g x 3", "kg", 1.5), ("90 g x3 pz", "kg", 0.27), ("1,5 l", "L", 1.5), ("2 dl", "L", 0.2), ("1 litro", "L", 1), ("due etti: 2 etti", "kg", 0.2), ("6 pz", "unit", 6), ("10 bustine", "unit", 10), ("conf da 4", "unit", 4), ("confezione da 8", "unit", 8), ("33 cl", "L", 0.33), ("CONF. DA 6", "unit", 6), ("2 × 1,5 L", "L", 3), ("4x grana 200gr", "kg", 0.2), ("3 grandi fette", None, None)])
def test_quantity(spark, text, base, value):
    q = one(spark, fn.parse_quantity(F.lit(text)))
    assert (q and (q.base_unit, round(q.base_value, 6))) == (base and (base, value))


def test_quantity_of_other_text_is_null(spark):
    assert one(spark, fn.parse_quantity(F.lit("al banco"))) is None
    assert one(spark, fn.parse_quantity(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("text, name, pct", [("Offerta 3 x 2", "three_for_two", 33.3), ("prendi 2 paghi 1", "two_for_price_of_one", 50), ("50% sul secondo", "second_half_price", 25), ("secondo pezzo al 50%", "second_half_price", 25), ("con carta", "loyalty_price", None), ("SOTTOCOSTO", "sottocosto", None), ("-30%", "percentage_off", 30), ("Sconto del 15 %", "percentage_off", 15), ("12%", "price_cut", None), ("13x2", "price_cut", None), ("PRENDI  3\nPAGHI 2", "three_for_two", 33.3), ("sconto 7%", "percentage_off", 7), ("secondo pezzo 50 %", "second_half_price", 25), ("Carta Fedelta'", "loyalty_price", None), ("", "price_cut", None), (None, "price_cut", None)])
def test_mechanic(spark, text, name, pct):
    m = one(spark, fn.parse_mechanic(F.lit(text).cast("string")))
    assert (m.mechanic, m.discount) == (name, pct)


@pytest.mark.parametrize("text, a, b", [("dal 17 al 29 aprile 2026", (2026, 4, 17), (2026, 4, 29)), ("DAL 28 APRILE AL 4 MAGGIO", (2025, 4, 28), (2025, 5, 4)), ("dal 1/4 al 30/4", (2025, 4, 1), (2025, 4, 30)), ("fino al 19 aprile", None, (2025, 4, 19)), ("17APR_29APR", (2025, 4, 17), (2025, 4, 29)), ("01.04 - 30.04", (2025, 4, 1), (2025, 4, 30))])
def test_italian_dates(spark, text, a, b):
    d = one(spark, fn.italian_range(F.lit(text), F.lit(2025)))
    assert (d.valid_from, d.valid_to) == (a and datetime.date(*a), datetime.date(*b))


def test_impossible_dates_are_null(spark):
    assert one(spark, fn.italian_range(F.lit("dal 31/2 al 31/2"), F.lit(2025))) is None


def test_similarity(spark):
    assert round(one(spark, sm.similarity(F.lit("word"), F.lit("two words"))), 4) == 0.3636
    assert one(spark, sm.similarity(F.lit(""), F.lit("x"))) == 0


def test_encryption_round_trip(spark):
    key = F.lit("0123456789abcdef")
    assert one(spark, fn.decrypt(fn.encrypt(F.lit("Anna"), key), key)) == "Anna"
    assert one(spark, fn.decrypt(F.lit("plain"), key)) == "plain"


@pytest.mark.parametrize("brand, name, quantity, key", [
    ("Barilla", "BARILLA Spaghetti n.5 al Forno", "1 kg", "barilla|spaghetti n5 forno|1000 g"),
    ("De Cecco", "Pasta di semola di grano duro Penne De Cecco", "500g", "de cecco|penne|500 g"),
    (None, "Caffè e zucchero", "2 X 100 g", "|caffe zucchero|2x100 g"), ("Mila", "Milano salame", "1,5l", "mila|milano salame|1500 ml"), ("X", None, None, "x||"),
])
def test_match_key(spark, brand, name, quantity, key):
    text = lambda v: F.lit(v).cast("string")
    assert one(spark, fn.match_key(text(brand), text(name), text(quantity))) == key


def test_unit_price_is_for_a_kilo_or_a_litre(spark):
    q = fn.parse_quantity(F.lit("500 g"))
    assert one(spark, fn.unit_price(F.lit(1.99), q["base_value"])) == 3.98
    assert one(spark, fn.unit_price(F.lit(1.99), F.lit(0.0))) is None
    assert one(spark, fn.unit_price(F.lit(1.99), q["base_value"], F.lit(4.5))) == 4.5


@pytest.mark.parametrize("name, slug", [("Latte e biscotti", "latticini"), ("PASTA SFOGLIA", "pasta"), ("Pastasciutta", "altro"), ("Crackers", "panificati"), ("Crema di riso", "cura-persona"), ("Caffè", "caffe-te"), (None, "altro")])
def test_category(spark, name, slug):
    assert one(spark, fn.infer_category(F.lit(name).cast("string"))) == slug


def test_tags(spark):
    assert one(spark, fn.dietary_tags(F.lit("Yogurt BIO senza lattosio"))) == ["senza-lattosio", "bio"]
    assert one(spark, fn.dietary_tags(F.lit("Latte bio"))) == ["bio"]
    assert one(spark, fn.dietary_tags(F.lit("Abbio"))) == ["bio"]


@pytest.mark.parametrize("parsed, mechanic, price, original, want", [(20, 30, 8, 10, 20), (None, 30, 8, 10, 30), (None, None, 8, 10, 20), (95, 30, 80, 100, None), (0, 30, 8, 10, None), (None, 100, 8, 10, None), (None, None, 10, 8, None), (None, None, 10, None, None), (None, None, 5, 0, None)])
def test_discount_is_bounded_after_the_cascade(spark, parsed, mechanic, price, original, want):
    number = lambda v: F.lit(v).cast("double")
    assert one(spark, fn.discount(*map(number, (parsed, mechanic, price, original)))) == want


@pytest.mark.parametrize("text, want", [("500G", "500 g"), ("1,5l", "1500 ml"), ("2 x 100 g", "2x100 g"), ("500 gr", "500 gr"), ("3 pz", "3 pz"), ("0,33 L", "330 ml"), ("5 dl", "500 ml"), (" Al Banco ", "al banco"), (None, None)])
def test_normal_quantity(spark, text, want):
    assert one(spark, fn.normalize_quantity(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("20260417000000", datetime.date(2026, 4, 17)), ("20260417", datetime.date(2026, 4, 17)), ("2026041", None), ("20261341000000", None), ("", None), (None, None)])
def test_compact_date(spark, text, want):
    assert one(spark, fn.compact_date(F.lit(text).cast("string"))) == want
