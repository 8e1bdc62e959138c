"""Multi-valued place (scope) handling driven by a place dictionary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pulsetrail import vocab
from pulsetrail.functions.text import strip

MAX_DICTIONARY_ROWS = 20_000


@dataclass(frozen=True)
class Places:
    """Dictionary of countries and regions.

    ``countries``: (name, aliases...) tuples in display order; ``regions``:
    name -> member names in display order; ``region_aliases``: alias -> region;
    ``all_words``: words that mean every market.
    """

    countries: tuple[tuple[str, ...], ...]
    regions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    region_aliases: dict[str, str] = field(default_factory=dict)
    all_words: tuple[str, ...] = ()
    all_name: str = vocab.SCOPE_ALL

    @classmethod
    def from_frames(cls, countries: DataFrame, regions: DataFrame, **kw) -> "Places":
        """From (name, aliases ARRAY, ord) and (region, members ARRAY, ord).

        A dictionary is configuration: more than ``MAX_DICTIONARY_ROWS`` rows
        is refused instead of being pulled to the driver.
        """
        def rows(df):
            got = df.orderBy("ord").limit(MAX_DICTIONARY_ROWS + 1).collect()
            if len(got) > MAX_DICTIONARY_ROWS:
                raise ValueError("place dictionary is too large to be a dictionary")
            return got
        return cls(tuple((r["name"], *r["aliases"]) for r in rows(countries)),
                   {r["region"]: tuple(r["members"]) for r in rows(regions)}, **kw)

    def lookup(self) -> dict[str, tuple[int, int, str]]:
        """Upper-case alias -> (kind, order, name); kind 0 all, 1 country, 2 region."""
        out: dict[str, tuple[int, int, str]] = {}
        for i, (name, *aliases) in enumerate(self.countries):
            for a in (name, *aliases):
                out[a.upper()] = (1, i, name)
        order = {r: i for i, r in enumerate(self.regions)}
        for alias, name in {**self.region_aliases, **{r: r for r in self.regions}}.items():
            out[alias.upper()] = (2, order[name], name)
        for w in (*self.all_words, self.all_name):
            out[w.upper()] = (0, 0, self.all_name)
        return out

    def reach(self, selected) -> list[str]:
        """Scope values that concern any of the selected countries."""
        sel = set(selected)
        return [self.all_name, *selected,
                *[r for r, members in self.regions.items() if sel & set(members) and r not in sel]]

    def literal_map(self) -> Column:
        pairs = []
        for alias, (kind, order, name) in self.lookup().items():
            pairs += [F.lit(alias), F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("ord"),
                                             F.lit(name).alias("name"))]
        return F.create_map(*pairs)


def normalise_tokens(tokens: Column, places: Places) -> Column:
    """Canonical names: countries in dictionary order, then regions.

    A word for every market wins over all else; so does finding nothing.  The
    dictionary is a literal map, so rows are neither exploded nor shuffled.
    """
    table = places.literal_map()
    # token edges: spaces, then dots, commas, quotes and square brackets
    bare = F.transform(tokens, lambda t: F.upper(F.regexp_replace(
        strip(t.cast("string")), r"""^[.,'"\[\]]+|[.,'"\[\]]+$""", "")))
    found = F.array_sort(F.filter(F.transform(bare, lambda t: F.try_element_at(table, t)),
                                  lambda x: x.isNotNull()))
    names = F.array_distinct(F.transform(found, lambda x: x["name"]))
    world = F.exists(found, lambda x: x["kind"] == 0) | (F.size(found) == 0)
    return F.when(F.coalesce(world, F.lit(True)), F.array(F.lit(places.all_name))).otherwise(names)


def normalise_scope(raw: Column, places: Places) -> Column:
    """``;``-joined text to canonical names."""
    return normalise_tokens(F.split(F.coalesce(raw, F.lit("")), ";"), places)


def migrate_scope(raw: Column, places: Places, legacy_codes) -> Column:
    """A list naming every legacy market means all; otherwise normalise."""
    codes = F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), strip)
    missing = F.array_except(F.array(*map(F.lit, legacy_codes)), codes)
    return (F.when(F.size(missing) == 0, F.array(F.lit(places.all_name)))
            .otherwise(normalise_scope(raw, places)))


def scope_migration_report(ledger: DataFrame, places: Places, legacy_codes, k: int = 8) -> DataFrame:
    """Token counts before and after, and the ``k`` commonest rewrites."""
    both = ledger.select(
        F.coalesce(F.nullif("raw_scope", F.lit("")), F.array_join("scope", ";")).alias("old"),
        F.array_join("scope", ";").alias("stored"))
    both = both.withColumn("new", migrate_scope(F.col("old"), places, legacy_codes))
    def counts(tokens, part):
        return (both.select(F.explode(tokens).alias("old")).filter(F.col("old") != "")
                .groupBy("old").agg(F.count("*").alias("n"))
                .select(F.lit(part).alias("part"), "old", F.lit("").alias("new"), "n"))
    joined = F.array_join("new", ";")
    rewrites = (both.filter(joined != F.col("stored")).groupBy("old", joined.alias("new"))
                .agg(F.count("*").alias("n"))
                .orderBy(F.desc("n"), "old", "new").limit(k)
                .select(F.lit("rewrite").alias("part"), "old", "new", "n"))
    return (counts(F.split("old", ";"), "before").unionByName(counts(F.col("new"), "after"))
            .unionByName(rewrites))


def scope_filter(ledger: DataFrame, places: Places, selected) -> DataFrame:
    """Events for all markets, a selected country, or a region holding one."""
    if not selected:
        return ledger
    return ledger.filter(F.arrays_overlap("scope", F.array(*map(F.lit, places.reach(selected)))))


def named_places(ledger: DataFrame, places: Places) -> DataFrame:
    """Distinct scope values in use, without the all-markets value."""
    return (ledger.select(F.explode("scope").alias("name")).filter(F.col("name") != places.all_name)
            .distinct())


def unclaimed(ledger: DataFrame, places: Places) -> DataFrame:
    """Named countries that no region group holds (regions are not countries)."""
    claimed = {c for m in places.regions.values() for c in m} | set(places.regions)
    return named_places(ledger, places).filter(~F.col("name").isin(*sorted(claimed)) if claimed
                                               else F.lit(True))


def facet_list(ledger: DataFrame, places: Places, pinned=(), other: str = vocab.OTHER_GROUP) -> DataFrame:
    """(region, country) pairs on offer: named or pinned countries by region.

    A region named only as itself offers all its members; unclaimed countries
    go to ``other``.
    """
    spark = ledger.sparkSession
    named = named_places(ledger, places).unionByName(
        spark.createDataFrame([(p,) for p in pinned] or [], "name string")).distinct()
    pairs = spark.createDataFrame([(r, i, m) for i, (r, ms) in enumerate(places.regions.items())
                                   for m in ms] or [], "region string, ord int, name string")
    got = pairs.join(named, "name", "left_semi").select("region", F.col("name").alias("country"))
    bare = (pairs.join(got.select("region").distinct(), "region", "left_anti")
            .join(named.select(F.col("name").alias("region")), "region", "left_semi")
            .select("region", F.col("name").alias("country")))
    rest = unclaimed(named.select(F.array("name").alias("scope")), places)
    return (got.unionByName(bare)
            .unionByName(rest.select(F.lit(other).alias("region"), F.col("name").alias("country"))))


def country_region(country: Column, places: Places) -> Column:
    """First region group holding the country, else ALL."""
    out = None
    for region, members in places.regions.items():
        test = country.isin(*members)
        out = F.when(test, region) if out is None else out.when(test, region)
    return out.otherwise("ALL") if out is not None else F.lit("ALL")


def scope_label(scope: Column) -> Column:
    return F.when(F.size(scope) > 0, F.array_join(scope, ", ")).otherwise("—")


def division_label(divisions: Column, all_label: str = vocab.SCOPE_ALL) -> Column:
    """All three divisions, or none, read as 'all'."""
    missing = F.array_except(F.array(*map(F.lit, vocab.DIVISIONS)), divisions)
    return (F.when((F.size(divisions) == 0) | (F.size(missing) == 0), all_label)
            .otherwise(F.array_join(divisions, ", ")))
