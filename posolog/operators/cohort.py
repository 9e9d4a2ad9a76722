"""Cohorts: sets of persons chosen by events, exposures and age.

A cohort is a one-column DataFrame.  It never visits the driver: extraction uses
it in a semi join, and cohorts combine with ``intersect`` and ``left_semi``.  The
concept sets of any number of definitions are one lookup, and each event table is
scanned once for all of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posolog.functions import fixed_values as V
from posolog.functions.values import age_at

Tables = Mapping[str, DataFrame]
CONFIG_FOLDER = Path(__file__).resolve().parent.parent / "cohorts"


def load_config(path: str | Path) -> dict[str, Any]:
    """Read and check a cohort definition; bundled ones may be given by name."""
    file = Path(path)
    if not file.exists() and (CONFIG_FOLDER / f"{path}.json").exists():
        file = CONFIG_FOLDER / f"{path}.json"
    if not file.exists():
        raise FileNotFoundError(f"cohort definition not found: {path}")
    return check_config(json.loads(file.read_text(encoding="utf-8")))


def check_config(config: Mapping[str, Any]) -> dict[str, Any]:
    if not (config.get("index_event") or {}).get("concept_ids"):
        raise ValueError("index_event.concept_ids must name at least one concept")
    for rule in config.get("inclusion_rules") or []:
        if rule.get("type") != "age_min":
            raise ValueError(f"unknown inclusion rule: {rule.get('type')!r}")
    return dict(config)


def concept_set(
    tables: Tables,
    concept_ids: Iterable[int],
    include_descendants: bool = False,
    descendant_of: Iterable[int] | None = None,
    exclude_descendants: Iterable[int] = (),
    valid_only: bool = False,
) -> DataFrame:
    """Listed concepts that exist, plus valid descendants.

    ``descendant_of`` expands other ids than those listed; ``valid_only`` also
    asks the listed concepts to be valid; ``exclude_descendants`` are removed
    from the expansion only.
    """
    ids = sorted({int(i) for i in concept_ids})
    concept = tables["concept"]
    listed = concept.where(F.col("concept_id").isin(ids))
    if valid_only:
        listed = listed.where("invalid_reason IS NULL")
    out = listed.select("concept_id")
    ancestors = sorted({int(i) for i in descendant_of}) if descendant_of is not None else ids
    if (include_descendants or descendant_of is not None) and ancestors:
        children = (
            tables["concept_ancestor"]
            .where(F.col("ancestor_concept_id").isin(ancestors))
            .select(F.col("descendant_concept_id").alias("concept_id"))
        )
        excluded = sorted({int(i) for i in exclude_descendants})
        if excluded:
            children = children.where(~F.col("concept_id").isin(excluded))
        valid = concept.where("invalid_reason IS NULL").select("concept_id")
        out = out.union(children.join(valid, "concept_id", "left_semi"))
    return out.distinct()


def concept_sets(tables: Tables, specs: Sequence[Mapping[str, Any]]) -> DataFrame:
    """(number, concept_id) of several definitions' concept sets, in one read.

    The same rules as ``concept_set``; ``exact_concept_ids`` are added without
    their descendants.  The vocabulary is read once for the listed and once for the
    expanded concepts, whatever the number of sets.
    """
    listed_ids, ancestor_ids = set(), set()
    listed, expanded = [], []
    concept, ancestor = F.col("concept_id"), F.col("ancestor_concept_id")
    valid = F.col("invalid_reason").isNull()
    for number, spec in enumerate(specs):
        ids = {int(i) for i in spec["concept_ids"]}
        exact = {int(i) for i in spec.get("exact_concept_ids") or ()}
        named = concept.isin(sorted(ids)) & (valid if spec.get("valid_only") else F.lit(True))
        if exact:
            named = named | concept.isin(sorted(exact))
        listed.append(F.when(named, F.lit(number)))
        listed_ids |= ids | exact
        above = spec.get("descendant_of")
        above = {int(i) for i in above} if above is not None else ids
        if above and (spec.get("include_descendants") or spec.get("descendant_of") is not None):
            below = ancestor.isin(sorted(above))
            excluded = sorted({int(i) for i in spec.get("exclude_descendants") or ()})
            if excluded:
                below = below & ~F.col("descendant_concept_id").isin(excluded)
            expanded.append(F.when(below, F.lit(number)))
            ancestor_ids |= above

    def numbers(found: Sequence[Column]) -> Column:
        return F.explode(F.array_compact(F.array(*found))).alias("number")

    out = (
        tables["concept"].where(concept.isin(sorted(listed_ids))).select(numbers(listed), "concept_id")
    )
    if expanded:
        children = (
            tables["concept_ancestor"]
            .where(ancestor.isin(sorted(ancestor_ids)))
            .select(numbers(expanded), F.col("descendant_concept_id").alias("concept_id"))
        )
        living = tables["concept"].where(valid).select("concept_id")
        out = out.union(children.join(living, "concept_id", "left_semi").select(*out.columns))
    return out.distinct()


class _Events:
    """Concept sets wanted of event tables; sets of one table share its scan."""

    def __init__(self) -> None:
        self.specs: list[Mapping[str, Any]] = []
        self.sources: dict[tuple[str, str, str], list[int]] = {}
        self.dated: list[int] = []

    def want(self, spec: Mapping[str, Any], domain: str, dated: bool = True) -> int:
        """Number of the set; later ``also`` may add tables to it."""
        self.specs.append(spec)
        number = len(self.specs) - 1
        if dated:
            self.dated.append(number)
            self.also(number, spec.get("domain") or domain, spec)
        else:
            self.also(number, domain, {})
        return number

    def also(self, number: int, domain: str, fields: Mapping[str, Any]) -> None:
        date_col, concept_col = V.EVENT_COLUMNS.get(domain, V.OTHER_EVENT_COLUMNS)
        source = (domain, fields.get("date_field") or date_col, fields.get("concept_field") or concept_col)
        self.sources.setdefault(source, []).append(number)

    def rows(self, tables: Tables) -> DataFrame:
        """Distinct (person_id, number, day); the day is NULL where none is asked for.

        The distinct combines before its shuffle, so a person with very many events
        shrinks to one row per set and calendar day.
        """
        scans = None
        of_set: list[list[int]] = [[] for _ in self.specs]
        for source, ((domain, date_col, concept_col), wanted) in enumerate(self.sources.items()):
            dated = any(number in self.dated for number in wanted)
            day = F.col(date_col).cast("date") if dated else F.lit(None).cast("date")
            scan = tables[domain].select(
                "person_id",
                F.col(concept_col).cast("bigint").alias("concept_id"),
                day.alias("day"),
                F.lit(source).alias("source"),
            )
            scans = scan if scans is None else scans.union(scan)
            for number in wanted:
                of_set[number].append(source)
        # Whether the join broadcasts the lookup follows from its measured size; where
        # it is shuffled, adaptive execution splits the partition of a common concept.
        places = F.array(*[F.array(*map(F.lit, sources)) for sources in of_set])
        lookup = concept_sets(tables, self.specs).select(
            "number", "concept_id", F.explode(F.get(places, F.col("number"))).alias("source")
        )
        asked = F.col("number").isin(self.dated)
        return (
            scans.join(lookup, ["source", "concept_id"])
            .select("person_id", "number", F.when(asked, F.col("day")).alias("day"))
            .distinct()
        )


def cohort_flags(
    tables: Tables,
    cohorts: Mapping[str, Mapping[str, Any] | str | Path],
    evidence: Mapping[str, tuple[Mapping[str, Any], Sequence[str]]] | None = None,
) -> DataFrame:
    """Persons with any event of the definitions, and a boolean per definition.

    ``cohorts`` are full definitions; ``evidence`` names concept sets with the event
    tables of which any one event will do.  Every event table is scanned once for
    all of them.  The first qualifying event and the bounds of the periods that hold
    one are window minima over a person's few rows; flags are read off in the
    aggregate behind the window, on the same exchange.
    """
    events = _Events()
    plans = []
    for name, config in cohorts.items():
        config = load_config(config) if isinstance(config, (str, Path)) else check_config(config)
        index = events.want(config["index_event"], "condition_occurrence")
        needs = [
            (events.want(need, "drug_exposure"), need.get("timing") or "on_or_after_index")
            for need in config.get("required_exposures") or []
        ]
        ages = [int(rule["value"]) for rule in config.get("inclusion_rules") or []]
        plans.append((name, index, needs, ages))
    shown = {}
    for name, (spec, domains) in (evidence or {}).items():
        first, *rest = domains
        shown[name] = events.want(spec, first, dated=False)
        for domain in rest:
            events.also(shown[name], domain, {})

    rows = events.rows(tables)
    number, day = F.col("number"), F.col("day")
    steps, aggregates = {}, {}
    by_person = Window.partitionBy("person_id")
    if plans:
        periods = tables["observation_period"].select(
            F.col("person_id").alias("op_person"),
            F.col("observation_period_start_date").cast("date").alias("op_start"),
            F.col("observation_period_end_date").cast("date").alias("op_end"),
        )
        inside = (
            (F.col("person_id") == F.col("op_person"))
            & number.isin([index for _, index, _, _ in plans])
            & day.between(F.col("op_start"), F.col("op_end"))
        )
        rows = rows.join(periods, inside, "left")
    for at, (_, index, needs, ages) in enumerate(plans):
        found = (number == index) & F.col("op_person").isNotNull()
        low, high, first = f"low_{at}", f"high_{at}", f"first_{at}"
        steps[first] = F.min(F.when(found, day)).over(by_person)
        steps[low] = F.min(F.when(found, F.col("op_start"))).over(by_person)
        steps[high] = F.max(F.when(found, F.col("op_end"))).over(by_person)
        aggregates[first] = F.max(first)
        for need, timing in needs:
            if timing == "on_or_after_index":
                in_time = day >= F.col(first)
            else:
                in_time = day.between(F.col(low), F.col(high))
            aggregates[f"need_{need}"] = F.bool_or((number == need) & in_time)
    for name, wanted in shown.items():
        aggregates[f"shown_{wanted}"] = F.bool_or(number == wanted)
    persons = rows.withColumns(steps).groupBy("person_id").agg(
        *[column.alias(name) for name, column in aggregates.items()]
    )
    if any(ages for _, _, _, ages in plans):
        people = tables["person"].groupBy("person_id").agg(F.min("year_of_birth").alias("year_of_birth"))
        persons = persons.join(people, "person_id", "left")

    flags = []
    for at, (name, _, needs, ages) in enumerate(plans):
        member = F.col(f"first_{at}").isNotNull()
        for need, _ in needs:
            member = member & F.col(f"need_{need}")
        for age in ages:
            member = member & (age_at(F.col(f"first_{at}"), F.col("year_of_birth")) >= age)
        flags.append(F.coalesce(member, F.lit(False)).alias(name))
    for name, wanted in shown.items():
        flags.append(F.coalesce(F.col(f"shown_{wanted}"), F.lit(False)).alias(name))
    return persons.select("person_id", *flags)


def build_cohort(tables: Tables, config: Mapping[str, Any] | str | Path) -> DataFrame:
    """Persons who satisfy a cohort definition."""
    return cohort_flags(tables, {"member": config}).where("member").select("person_id")


def persons_with_concepts(
    tables: Tables,
    spec: Mapping[str, Any],
    domains: Sequence[str] = ("condition_occurrence",),
    person_ids: DataFrame | None = None,
) -> DataFrame:
    """Persons with any event of the concept set in one of ``domains``.

    With several domains the evidence is united; ``person_ids`` restricts the
    result to another cohort.
    """
    found = cohort_flags(tables, {}, {"shown": (spec, domains)}).where("shown").select("person_id")
    if person_ids is not None:
        found = found.join(person_ids.select("person_id"), "person_id", "left_semi")
    return found


def tier_members(
    tables: Tables,
    base: Mapping[str, Any] | str | Path,
    infection: Mapping[str, Any],
    vaccine: Mapping[str, Any],
) -> DataFrame:
    """(tier, person_id): a cohort, the infections within it, the vaccinated of those.

    All tiers come from one pass over the event tables.
    """
    flags = cohort_flags(
        tables,
        {"base": base},
        {
            "infection": (infection, ("condition_occurrence",)),
            "vaccinated": (vaccine, ("drug_exposure", "procedure_occurrence")),
        },
    )
    infected = F.col("base") & F.col("infection")
    tiers = F.array(
        F.when(F.col("base"), F.lit("base")),
        F.when(infected, F.lit("infection")),
        F.when(infected & F.col("vaccinated"), F.lit("vaccinated")),
    )
    return flags.select(F.explode(F.array_compact(tiers)).alias("tier"), "person_id")


def rheumatic_dmard(tables: Tables) -> DataFrame:
    """Adults with a rheumatic disease and a disease-modifying drug."""
    return build_cohort(tables, "rheumatic_dmard")


def zoster_antivirals(tables: Tables) -> DataFrame:
    """Adults with zoster, an antiviral afterwards and an immunosuppressant."""
    return build_cohort(tables, "zoster_antivirals")


def zoster_infection(tables: Tables, person_ids: DataFrame | None = None) -> DataFrame:
    config = load_config("zoster_infection")
    return persons_with_concepts(
        tables, config["index_event"], ("condition_occurrence",), person_ids
    )


def zoster_vaccine(tables: Tables, person_ids: DataFrame | None = None) -> DataFrame:
    config = load_config("zoster_vaccine")
    return persons_with_concepts(
        tables,
        config["index_event"],
        ("drug_exposure", "procedure_occurrence"),
        person_ids,
    )


def cohort_tiers(tables: Tables) -> dict[str, DataFrame]:
    """Base cohort, infections within it, and vaccinated persons within those."""
    members = tier_members(
        tables,
        "rheumatic_dmard",
        load_config("zoster_infection")["index_event"],
        load_config("zoster_vaccine")["index_event"],
    )
    return {
        tier: members.where(F.col("tier") == tier).select("person_id")
        for tier in ("base", "infection", "vaccinated")
    }


def intersect_cohorts(*cohorts: DataFrame) -> DataFrame:
    out = cohorts[0].select("person_id")
    for other in cohorts[1:]:
        out = out.intersect(other.select("person_id"))
    return out


def subtract_cohort(cohort: DataFrame, other: DataFrame) -> DataFrame:
    return cohort.select("person_id").subtract(other.select("person_id"))
