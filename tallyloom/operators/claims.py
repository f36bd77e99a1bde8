"""Facts out of the claims of a knowledge base's entities, and the names of what they refer to, in two phases.

Claims are JSON: by property a list of statements, each with a main snak of a type and a value that may be text or an object.
They are read as variant values, so that a property's statements may differ in kind. Broken JSON counts as no claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.shared import cut

#: The properties that are read.
INSTANCE_OF, COUNTRY, DISTRICT, FOUNDED, DISSOLVED, WEBSITE, RECORD_ID, POSTAL_CODE = "P31", "P17", "P5353", "P571", "P576", "P856", "P2484", "P281"


def parsed(json: Column) -> Column:
    return F.try_parse_json(json)


def values(claims: Column, prop: str) -> Column:
    """The values of a property's statements that have one, in order; an empty array if there is none."""
    snaks = F.try_variant_get(claims, f"$.{prop}", "array<variant>")
    kept = F.filter(snaks, lambda s: F.coalesce(F.try_variant_get(s, "$.mainsnak.snaktype", "string") == "value", F.lit(False)))
    found = F.transform(kept, lambda s: F.try_variant_get(s, "$.mainsnak.datavalue.value", "variant"))
    return F.coalesce(found, F.array().cast("array<variant>"))


def text(value: Column) -> Column:
    """A value that is text; '' for any other."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise("")


def ids(found: Column) -> Column:
    """The ids of all entities among a property's values, in order, repeats kept."""
    return F.filter(F.transform(found, lambda v: F.try_variant_get(v, "$.id", "string")), lambda i: F.coalesce(i != "", F.lit(False)))


def year(value: Column) -> Column:
    """The year of a time such as +1950-00-00T00:00:00Z, with its sign if it is before the common era; '' if there is none."""
    return F.ltrim(F.regexp_extract(F.coalesce(F.try_variant_get(value, "$.time", "string"), F.lit("")), "([+-][0-9]{4})", 1), F.lit("+"))


def facts(entities: DataFrame, *, key: str = "qid", json_col: str = "claims") -> DataFrame:
    """key, type_ids (array), country_id, district_id, dissolved, founded, website, record_id, postal_code of each entity.

    country_id is the first that is named, district_id only what the first statement names.
    """
    read = (INSTANCE_OF, COUNTRY, DISTRICT, FOUNDED, DISSOLVED, WEBSITE, RECORD_ID, POSTAL_CODE)
    # each step is a projection of its own, so that the text is parsed once and each property read once
    found = entities.select(key, parsed(F.col(json_col)).alias("_claims")).select(key, *[values(F.col("_claims"), prop).alias(f"_{prop}") for prop in read])
    first = lambda prop: F.get(f"_{prop}", 0)
    some = {name: text(first(prop)) for name, prop in (("website", WEBSITE), ("record_id", RECORD_ID), ("postal_code", POSTAL_CODE))}
    return found.select(
        key,
        ids(F.col(f"_{INSTANCE_OF}")).alias("type_ids"),
        F.get(ids(F.col(f"_{COUNTRY}")), 0).alias("country_id"),
        F.nullif(F.try_variant_get(first(DISTRICT), "$.id", "string"), F.lit("")).alias("district_id"),
        (F.size(f"_{DISSOLVED}") > 0).alias("dissolved"),
        year(first(FOUNDED)).alias("founded"),
        *[F.coalesce(v, F.lit("")).alias(name) for name, v in some.items()],
    )


def needed(found: DataFrame) -> DataFrame:
    """The distinct ids whose labels the second phase has to look up: a column id."""
    every = F.concat("type_ids", F.array_compact(F.array("country_id", "district_id")))
    return found.select(F.explode(every).alias("id")).distinct()


def labelled(found: DataFrame, labels: DataFrame, *, key: str = "qid") -> DataFrame:
    """found with instance_of (array), country and school_district: labels (id, label) in the order of the ids, blank ones left out.

    One row for each key of found. Each id meets its label in one join, whatever names it; an entity's labels are
    gathered again by their place.
    """
    place = lambda tag, ids: F.transform(ids, lambda x, i: F.struct(F.lit(tag).alias("tag"), i.alias("place"), x.alias("id")))
    every = F.concat(place("t", F.col("type_ids")), place("c", F.array_compact(F.array("country_id"))), place("d", F.array_compact(F.array("district_id"))))
    named = found.select(key, F.inline(every)).join(labels.where("label <> ''").select("id", "label").dropDuplicates(["id"]), "id")
    again = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("tag", "place", "label"))).alias("all"))
    of = lambda tag: F.coalesce(F.transform(F.filter("all", lambda x: x["tag"] == tag), lambda x: x["label"]), F.array().cast("array<string>"))
    one = lambda tag: F.coalesce(F.get(of(tag), 0), F.lit(""))
    return found.join(again, key, "left").withColumns({"instance_of": of("t"), "country": one("c"), "school_district": one("d")}).drop("all")


def enrich(records: DataFrame, entities: DataFrame, labels: DataFrame, *, key: str = "qid", json_col: str = "claims") -> DataFrame:
    """records with what the claims of their entity say; blank where there are none.

    An entity that is there twice counts once, whichever comes; records that share one get the same.
    """
    # the claims' text goes no further than the task that reads it: what is shuffled is its facts, and the cut table serves both phases
    found = cut(facts(entities.where(F.col(key).isNotNull()), key=key, json_col=json_col).dropDuplicates([key]))
    got = labelled(found, labels, key=key)
    got = got.drop("type_ids", "country_id", "district_id")
    text_columns = ["country", "school_district", "founded", "website", "record_id", "postal_code"]
    out = records.join(got, key, "left").na.fill("", text_columns).na.fill(False, ["dissolved"])
    return out.withColumn("instance_of", F.array_join(F.coalesce("instance_of", F.array().cast("array<string>")), "|"))
