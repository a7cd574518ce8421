"""Parties and ideologies of entities from infobox tables (ids S22, X30-X32, U6).

infobox: entity, fields MAP<STRING, STRING>; the fetch itself needs a network and is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import wiki_links


def nonempty(infobox: DataFrame) -> DataFrame:
    """Entities with at least one field."""
    return infobox.filter(F.coalesce(F.size("fields"), F.lit(0)) > 0)


def parties(infobox: DataFrame, field: str = "party") -> DataFrame:
    """Entity, party: the linked names of a field, once each."""
    return infobox.select("entity", F.explode(F.array_distinct(wiki_links(F.col("fields")[field]))).alias("party"))


def ideology_text(infobox: DataFrame, fields=("ideology", "position")) -> DataFrame:
    """Linked names of the ideology fields of a party, joined by spaces."""
    names = F.flatten(F.array(*(F.coalesce(wiki_links(F.col("fields")[f]), F.array().cast("array<string>")) for f in fields)))
    return infobox.select(F.col("entity").alias("party"), F.array_join(F.array_distinct(names), " ").alias("ideology")).filter("ideology <> ''")


def entity_ideology(party_table: DataFrame, ideologies: DataFrame) -> DataFrame:
    """Per entity the ideologies of its parties."""
    return party_table.join(ideologies, "party").groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("ideology")), " ").alias("ideology"))


def affiliations(party_table: DataFrame, sides: dict[str, tuple[str, ...]]) -> DataFrame:
    """Entity, label for entities with parties of one side only; sides: label -> names of its parties."""
    label = F.lit(None).cast("string")
    for name, own in sides.items():
        label = F.when(F.col("party").isin(*own), F.lit(name)).otherwise(label)
    found = party_table.withColumn("label", label).filter("label is not null").groupBy("entity").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    return found.filter("label = other").select("entity", "label")
