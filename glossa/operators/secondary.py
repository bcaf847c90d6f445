"""Smaller record operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T


def merge_features(df: DataFrame, maps: list[str], definitions: DataFrame) -> DataFrame:
    """JSON feature maps of each url merged and keyed by their index (X4); later maps win, unknown keys go."""
    each = None
    for rank, m in enumerate(maps):
        rows = df.select("url", F.lit(rank).alias("_rank"), F.explode(F.from_json(m, "map<string,double>")).alias("feature", "value"))
        each = rows if each is None else each.unionByName(rows)
    best = each.groupBy("url", "feature").agg(F.max_by("value", "_rank").alias("value"))
    return best.join(definitions.select("feature", "id"), "feature").groupBy("url").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "value")))).alias("features"))


def functional_attributes(tokens: DataFrame, category: str, surface: str, least: int = 3, nouns: DataFrame | None = None) -> DataFrame:
    """category, token, n of uncapitalised tokens that a category has often (X6); with a noun list only its words."""
    t = tokens.filter(F.col(surface).rlike("^[a-z]")).groupBy(category, F.col(surface).alias("token")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return t if nouns is None else t.join(nouns.select(F.col(nouns.columns[0]).alias("token")).distinct(), "token", "left_semi")


def attribute_categories(attributes: DataFrame, token: str, category: str, least: int = 3) -> DataFrame:
    """token and its number of categories, of those in at least ``least``."""
    return attributes.select(token, category).distinct().groupBy(token).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def annotations(paths: Column) -> Column:
    """The first two parts of a category path."""
    return T.category_parent(paths, 2)


def dependency_pairs(parses: DataFrame) -> DataFrame:
    """(head, dependent) -> "a-b" keys in lower case with counts, without the root and punctuation."""
    ok = ~F.col("head").isin("ROOT") & ~T.is_punctuation("head") & ~T.is_punctuation("dependent")
    return parses.filter(ok).groupBy(F.concat_ws("-", F.lower("head"), F.lower("dependent")).alias("pair")).agg(F.count("*").alias("n"))


def entity_counts(mentions: DataFrame) -> DataFrame:
    """(segment, type, entity) -> counts over distinct segments."""
    return mentions.select("segment", "type", "entity").distinct().groupBy("type", "entity").agg(F.count("*").alias("n"))


def synset_counts(tokens: DataFrame, senses: DataFrame) -> DataFrame:
    """(token, n) and (token, synset) -> summed counts of each synset."""
    return tokens.join(senses.distinct(), "token").groupBy("synset").agg(F.sum("n").alias("n"))


def tagged_nouns(c: Column | str) -> Column:
    """Tokens of ``token/TAG/status`` items with a noun tag."""
    items = F.filter(F.split(F.col(c) if isinstance(c, str) else c, " "), lambda x: x.rlike(r"^.+/NN[^/]*/[^/]*$"))
    return F.transform(items, lambda x: F.regexp_extract(x, r"^(.+)/[^/]+/[^/]*$", 1))


def slot_fillers(df: DataFrame, filler: str, tag: str) -> DataFrame:
    """Distinct fillers but for case, without verbs (X17); the least spelling stands for all."""
    return df.filter(~F.col(tag).startswith("VB")).groupBy(F.lower(filler).alias("_f")).agg(F.min(filler).alias(filler)).drop("_f")


def triples(df: DataFrame, concepts: DataFrame) -> DataFrame:
    """Lines ``subject predicate object`` whose subject is a concept; lines with # are left out."""
    c = df.filter(~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+", 3).alias("p")).filter(F.size("p") == 3)
    t = c.select(F.col("p")[0].alias("subject"), F.col("p")[1].alias("predicate"), F.col("p")[2].alias("object"))
    return t.join(concepts.select(F.col(concepts.columns[0]).alias("subject")).distinct(), "subject", "left_semi")


def surface_entities(df: DataFrame, longest: int = 128) -> DataFrame:
    """(entity, surfaces) -> surface and its entities in order, of surfaces that aren't too long."""
    each = df.select("entity", F.explode("surfaces").alias("surface")).filter(F.length("surface") <= longest).distinct()
    return each.groupBy("surface").agg(F.sort_array(F.collect_list("entity")).alias("entities"))


def resource_types(df: DataFrame) -> DataFrame:
    """(resource, type) -> JSON array of the types in order."""
    return df.distinct().groupBy("resource").agg(F.to_json(F.sort_array(F.collect_list("type"))).alias("types"))


def html_regions(c: Column | str) -> dict[str, Column]:
    """Texts of the title, headers, links and the whole body."""
    h = T.strip_scripts(c)
    inner = lambda tag: T.trim_spaces(F.regexp_replace(T.unescape(F.array_join(F.regexp_extract_all(h, F.lit(rf"(?is)<({tag})\b[^>]*>(.*?)</\1\s*>"), 2), " ")), r"(?s)<[^>]*>", " "))
    return {"title": T.html_title(c), "header": inner("h[1-6]"), "link": inner("a"), "body": T.html_text(c)}


def abstract_slots(tokens: Column, tags: Column) -> Column:
    """Adverbs and adjectives as slots, neighbouring slots merged into one."""
    named = F.zip_with(tokens, tags, lambda t, g: F.when(T.has_pos(g, "adverb"), "SLOT_ADVERB").when(T.has_pos(g, "adjective"), "SLOT_ADJECTIVE").otherwise(t))
    return F.aggregate(named, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) > 0) & F.element_at(a, -1).startswith("SLOT_") & x.startswith("SLOT_"), a).otherwise(F.concat(a, F.array(x))))


#: Lines of whois answers that say nothing about an owner. Fixed values.
WHOIS_DROPPED = (
    r"For more information on Whois status codes",
    r"^(?-i:NOT FOUND)$",
    r"^No match for domain",
    r"^WHOIS Server:",
    r"^Creation Date:",
    r"^Updated Date:",
    r"^Registry Expiry Date:",
    r"^Sponsoring Registrar",
    r"^Name Server:",
    r"^DNSSEC:",
    r"^(?:Domain )?Status:",
)


def whois_lines(c: Column | str) -> Column:
    """Lines that may name an owner, without what stands before their first colon, distinct but for case."""
    lines = F.transform(F.split(F.col(c) if isinstance(c, str) else c, r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~reduce(lambda found, p: found | x.rlike(f"(?i){p}"), WHOIS_DROPPED, F.lit(False)))
    values = F.filter(F.transform(kept, lambda x: T.clean(F.regexp_replace(x, r"^[^:]+:", ""))), lambda x: x != "")
    low = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def explode_fields(df: DataFrame, key: str, fields: list[str]) -> dict[str, DataFrame]:
    """One (key, value) table a field."""
    return {f: df.select(key, F.col(f).alias("value")) for f in fields}


def contexts_from_xml(df: DataFrame, column: str) -> DataFrame:
    """Context elements of XML strings, one row each, whether there is one or several."""
    each = F.posexplode(F.xpath(column, F.lit("/Context/ContextElement/text()")))
    return df.select(*[c for c in df.columns if c != column], each.alias("ord", "context"))


def value_samples(df: DataFrame, group: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group in a seeded order that any partitioning gives."""
    from glossa.operators.splits import digest_order, top_per_group

    return top_per_group(df, [group], [digest_order(seed, *df.columns).asc(), *[F.asc(c) for c in df.columns]], n, "_k").drop("_k")
