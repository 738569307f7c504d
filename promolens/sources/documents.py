"""Job-result documents, property bags, CSV work lists and literal dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "struct<page: int, raw_text: string, extracted: string, valid_from: string, valid_to: string>"
JOB = f"job_id string, chain string, results array<{RESULT}>"
#: Names that extractors use for one field.
ALIASES = {"name": ["prodotto", "product_name", "nome_prodotto"], "price": ["prezzo_offerta", "price", "prezzo"], "original": ["prezzo_originale", "original_price"], "quantity": ["quantita_peso", "quantity", "formato"], "brand": ["brand", "marca"], "discount": ["sconto_percentuale", "discount_pct"], "mechanic": ["tipo_offerta", "mechanic"], "valid_from": ["validita_inizio", "valid_from"], "valid_to": ["validita_fine", "valid_to"]}
#: The categories and the chains that the platform starts with.
CATEGORIES = [
    ("frutta-verdura", "Frutta e Verdura", 10), ("panificati", "Panificati", 20), ("latticini", "Latticini", 30), ("carne", "Carne", 40), ("salumi", "Salumi", 50), ("pesce", "Pesce", 60),
    ("pasta", "Pasta", 70), ("riso-cereali", "Riso e Cereali", 80), ("condimenti", "Condimenti", 90), ("dolci-snack", "Dolci e Snack", 100), ("caffe-te", "Caffè e Tè", 110), ("bevande", "Bevande", 120),
    ("bevande-alcoliche", "Bevande Alcoliche", 130), ("surgelati", "Surgelati", 140), ("cura-casa", "Cura Casa", 150), ("cura-persona", "Cura Persona", 160), ("animali", "Animali", 170), ("altro", "Altro", 999),
]


def read_job_results(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row a result: job_id, chain, pos, page, raw_text, extracted (JSON text), validity.

    A file is one document, or holds one on each line.
    """
    rows = spark.read.schema(JOB).option("multiLine", one_per_file).json(path)
    return explode_results(rows)


def explode_results(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "chain", F.posexplode("results").alias("pos", "r")).select("job_id", "chain", "pos", "r.*")


def flatten_extracted(results: DataFrame) -> DataFrame:
    """One row a product (item: map of texts): an array gives its elements, an object with numeric keys its values, another object itself."""
    maps = "array<map<string,string>>"
    as_list = F.from_json("extracted", maps)
    nested = F.from_json("extracted", "map<string,string>")
    numeric = (F.size(F.map_keys(nested)) > 0) & F.forall(F.map_keys(nested), lambda k: k.rlike(r"^\d+$"))
    values = F.transform(F.map_values(nested), lambda v: F.from_json(v, "map<string,string>"))
    items = F.when(F.ltrim("extracted").startswith("["), as_list).when(numeric, values).when(nested.isNotNull(), F.array(nested))
    return results.withColumn("items", items).select("*", F.posexplode("items").alias("item_pos", "item")).drop("items", "extracted")


def flatten_variant(results: DataFrame) -> DataFrame:
    """One row a product (item: VARIANT), so that numbers and nested values keep their kind.

    An array gives its elements, an object with numeric keys its values, another object
    itself; other JSON and texts that are none give nothing.
    """
    v = F.try_parse_json("extracted")
    listed, named = v.try_cast("array<variant>"), v.try_cast("map<string,variant>")
    numeric = (F.size(F.map_keys(named)) > 0) & F.forall(F.map_keys(named), lambda k: k.rlike(r"^\d+$"))
    items = F.when(listed.isNotNull(), listed).when(numeric, F.map_values(named)).when(named.isNotNull(), F.array(v))
    return results.withColumn("items", items).select("*", F.posexplode("items").alias("item_pos", "item")).drop("items", "extracted")


def unify_variant(items: DataFrame, aliases: dict[str, Sequence[str]] | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """Columns for the fields that extractors name differently, of the asked kinds (text without one); the first name that has such a value wins."""
    kinds = kinds or {}
    get = lambda n, kind: F.try_variant_get("item", f"$.{n}", kind)
    return items.withColumns({field: F.coalesce(*[get(n, kinds.get(field, "string")) for n in names]) for field, names in (aliases or ALIASES).items()})


def unify_fields(items: DataFrame, aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Columns for the fields that extractors name differently; the first name that has a value wins."""
    return items.withColumns({field: F.coalesce(*[F.element_at("item", n) for n in names]) for field, names in (aliases or ALIASES).items()})


def propagate_validity(products: DataFrame, results: DataFrame, keys: Sequence[str] = ("job_id", "pos")) -> DataFrame:
    """A product without dates takes those of its result."""
    r = results.select(*keys, F.col("valid_from").alias("__f"), F.col("valid_to").alias("__t"))
    return products.join(r, list(keys), "left").withColumns({"valid_from": F.coalesce("valid_from", "__f"), "valid_to": F.coalesce("valid_to", "__t")}).drop("__f", "__t")


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def pivot_properties(df: DataFrame, codes: Sequence[str], props: str = "props") -> DataFrame:
    """Property bags (arrays of {code, values}) to a column each, first values; hidden rows and prices that are not positive go."""
    bag = F.map_from_entries(F.transform(F.filter(props, lambda p: F.size(p["values"]) > 0), lambda p: F.struct(p["code"], p["values"][0])))
    out = df.withColumns({c: F.try_element_at(bag, F.lit(c)) for c in codes})
    if "hidden" in codes:
        out = out.where("hidden IS NULL OR hidden <> 'true'")
    if "price" in codes:
        out = out.withColumn("price", F.col("price").try_cast("decimal(8,2)")).where("price > 0")
    return out.drop(props)


def taxonomy(spark: SparkSession) -> DataFrame:
    """The categories in their order."""
    return spark.createDataFrame([(i + 1, *c) for i, c in enumerate(CATEGORIES)], "id int, slug string, name string, sort_order int")


def write_worklist(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def apply_image_csv(sk: DataFrame, rows: DataFrame) -> DataFrame:
    """Set image URLs from text rows (id, image_url): numeric ids and http(s) URLs only, the last of an id by ``pos``."""
    good = rows.select(F.trim("id").try_cast("long").alias("id"), F.trim("image_url").alias("u"), "pos").where(F.col("id").isNotNull() & F.lower("u").rlike(r"^https?://\S+$"))
    last = good.groupBy("id").agg(F.max_by("u", "pos").alias("__u"))
    return sk.join(last, "id", "left").withColumn("image_url", F.coalesce("__u", "image_url")).drop("__u")


def read_image_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("id string, image_url string").csv(path)
    return rows.withColumn("pos", F.monotonically_increasing_id())  # the order in the file, used for ties of one read only


def drop_null_items(products: DataFrame, name: Column | None = None) -> DataFrame:
    return products.where((name if name is not None else F.col("name")).isNotNull())
