"""Flyer layouts on pages written for these tests."""

from promolens.operators import layouts

BLOCKS = """Eurospin volantino
2,99
3,99
/
BISCOTTI AL LATTE
DOLCE FORNO,
8 PZ
328 g
al kg Euro 9,12 1,49
1,99
/
SUCCO DI MELA
1 l
al l Euro 1,49 0,89
cad. 1,19
/
SPUGNA PER PIATTI
2 PZ 3,19
4,29
/
DETERSIVO PIATTI
750 ml
al litro Euro 4,25
pagina due
4,49
cad. 2,49
/
cad.
PADELLA ANTIADERENTE
7,99
9,99
/
PROSCIUTTO COTTO
al kg
al kg Euro 7,99
3,49
/
NON VALE
1,00
2,00
/
Hotel sul mare
al pezzo Euro 1,00"""


def test_blocks_of_all_starts_and_carried_prices(spark):
    docs = spark.createDataFrame([(1, BLOCKS), (2, None), (3, ""), (None, BLOCKS), (4, "1,00\n2,00\n/\nRISO")], "doc_id long, text string")
    got = [(r.doc_id, r.name, r.offer, r.original, r.unit_price, r.unit, r.quantity, r.discount) for r in layouts.extract_price_blocks(docs).orderBy("doc_id", "pos").collect()]
    assert got == [
        (1, "BISCOTTI AL LATTE DOLCE FORNO", 2.99, 3.99, 9.12, "kg", "8 PZ x 328 g", 25),
        (1, "SUCCO DI MELA", 1.49, 1.99, 1.49, "litro", "1 l", 25),
        (1, "SPUGNA PER PIATTI", 0.89, 1.19, None, None, "2 PZ", 25),
        (1, "DETERSIVO PIATTI", 3.19, 4.29, 4.25, "litro", "750 ml", 26),
        (1, "PADELLA ANTIADERENTE", 2.49, 4.49, None, None, None, 45),
        (1, "PROSCIUTTO COTTO", 7.99, 9.99, 7.99, "kg", "al kg", 20),
    ]


def test_a_block_ends_after_its_lines(spark):
    text = "1,00\n2,00\n/\n" + "\n".join(f"RIGA {i}" for i in range(25)) + "\nal kg Euro 3,00 4,00\n5,00\n/\nDOPO LA FINE"
    got = layouts.extract_price_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r.name for r in got] == [" ".join(f"RIGA {i}" for i in range(18))]


FLYER = """DA VENERDÌ 17 A MERCOLEDÌ 29 APRILE 2026
Supermercato di prova
CAFFÈ GUSTO PIENO
MOKA BELLA
macinato fresco,
250 g x 4
8,90 €
-35% € 13,69
CREMA ALLE NOCCIOLE
DOLCE ORO
600 g
anziché €/kg 9,98 3,99€
€/kg 6,65
-33%
€ 5,99
DETERSIVO PIATTI
SPLENDO
1 l
1,99 €
€/l 1,99
MORTADELLA
CON PISTACCHIO
10,90
€
al kg
FORMAGGIO A FETTE
BAITA BELLA
20
SCONTO %
BIBITA ALL'ARANCIA
FONTE CHIARA
75 cl
0,69
€/l 0,92
CAFFÈ GUSTO PIENO
SOLO TITOLARI
15%
PEPERONI
ROSSI E GIALLI
12
500 g
1,49 €
€/kg 2,98
BROCCOLI
ITALIANI
-20% € 1,86
HOTEL AL MARE
99,00 €
€/kg 1,00
STRACCHINO
CASA MIA
165 g
1,79€
€/kg 10,85
-28% € 2,49
STRACCHINO
CASA MIA
165 g
1,79 €
€/kg 10,85
PARMIGIANO REGGIANO
DOP 24 MESI
150 g
3,18 € €/kg 21,20 -20% € 3,98
PESCE SURGELATO
ONDA BLU
400 g
4,74 €
anziché €/kg 23,70 -50% € 9,48
MASCARPONE
250 g
3,49€ -32% € 5,14
PATATE
NOVELLE
1 kg
30%
fine"""


def test_seven_passes_and_their_claims(spark):
    docs = spark.createDataFrame([(1, FLYER), (2, None), (3, "niente"), (None, FLYER)], "doc_id long, text string")
    got = {(r["pass"], r.name): (r.brand, r.quantity, r.offer, r.original, r.discount, r.unit_price, r.unit) for r in layouts.extract_by_passes(docs).collect()}
    assert got == {
        (1, "CAFFÈ GUSTO PIENO"): ("MOKA BELLA", "250 g x 4", 8.9, 13.69, 35, None, None),
        (2, "CREMA ALLE NOCCIOLE"): ("DOLCE ORO", "600 g", 3.99, 5.99, 33, 6.65, "kg"),
        (3, "DETERSIVO PIATTI"): ("SPLENDO", "1 l", 1.99, None, None, 1.99, "litro"),
        (4, "MORTADELLA CON PISTACCHIO"): (None, None, 10.9, None, None, 10.9, "kg"),
        (5, "FORMAGGIO A FETTE"): ("BAITA BELLA", None, None, None, 20, None, None),
        (6, "BIBITA ALL'ARANCIA"): ("FONTE CHIARA", "75 cl", 0.69, None, None, 0.92, "litro"),
        (7, "CAFFÈ GUSTO PIENO"): (None, None, None, None, 15, None, None),
        (1, "PEPERONI ROSSI E GIALLI"): (None, "500 g", 1.49, 1.86, 20, 2.98, "kg"),
        (1, "STRACCHINO"): ("CASA MIA", "165 g", 1.79, 2.49, 28, 10.85, "kg"),
        (1, "PARMIGIANO REGGIANO DOP 24 MESI"): (None, "150 g", 3.18, 3.98, 20, 21.2, "kg"),
        (1, "PESCE SURGELATO"): ("ONDA BLU", "400 g", 4.74, 9.48, 50, 23.7, "kg"),
        (1, "MASCARPONE"): (None, "250 g", 3.49, 5.14, 32, None, None),
        (7, "PATATE"): ("NOVELLE", "1 kg", None, None, 30, None, None),
    }
