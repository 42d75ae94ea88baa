"""Who may say what: semantic ids against their nodes, snapshots against their registration, owners of languages."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlake.functions.docs import encode_component

SEMANTIC = r"^@(v2|g2)/([^/]+)/([0-9a-f]{64})#([^#]+):([^:]+)$"


def semantic_violations(nodes: DataFrame) -> DataFrame:
    """``id`` of nodes whose semantic id says another language, kind or name than they have."""
    own = nodes.filter(F.rlike("id", F.lit(SEMANTIC)))
    part = lambda n: F.regexp_extract("id", SEMANTIC, n)
    shown = F.coalesce("qualified_name", "name")
    return own.filter((part(2) != F.col("language")) | (part(5) != F.col("kind")) | (part(4) != encode_component(shown))).select("id")


@dataclass(frozen=True)
class Provider:
    """A registered provider: what it is called, how far it may be trusted, which languages it owns and which edges it can prove."""

    name: str
    authority: str
    languages: tuple[str, ...]
    facts: tuple[str, ...]
    fallbacks: tuple[Provider, ...] = field(default=())


def contract_violations(provider: Provider, nodes: DataFrame, edges: DataFrame, provenance: dict, languages: list[str]) -> DataFrame:
    """``rule``, ``subject`` of what a snapshot says beyond its provider's registration."""
    spark, said = nodes.sparkSession, []
    said += [("a language that it does not own", x) for x in languages if x not in provider.languages]
    for key, want in (("provider", provider.name), ("authority", provider.authority)):
        if provenance.get(key) != want:
            said.append((f"provenance has another {key}", str(provenance.get(key))))
    if sorted(provenance.get("facts", [])) != sorted(provider.facts):
        said.append(("provenance claims other facts", ",".join(sorted(provenance.get("facts", [])))))
    rule = lambda df, text, *subject: df.select(F.lit(text).alias("rule"), F.concat_ws(" ", *subject).alias("subject"))
    known = nodes.select("id").unionAll(nodes.filter("file <> ''").select("file")).distinct()
    found = [
        spark.createDataFrame(said, "rule string, subject string"),
        rule(edges.filter(~F.col("kind").isin(list(provider.facts))), "an edge of a family that it cannot prove", "src", "dst", "kind"),
        rule(nodes.filter(~F.col("language").isin(languages)), "a node of a language that the slice does not name", "id"),
        *[rule(edges.join(known.select(F.col("id").alias(e)), e, "left_anti"), "an absent end", "src", "dst", "kind") for e in ("src", "dst")],
    ]
    return reduce(lambda a, b: a.unionAll(b), found)


def registry_errors(registry: list[Provider]) -> list[str]:
    """Why providers cannot stand beside each other: one name twice, no language, repeated facts, unlike fallbacks, two owners."""
    errors, names, owners = [], set(), {}
    for provider in registry:
        for route in (provider, *provider.fallbacks):
            if route.name in names:
                errors.append(f"{route.name} is registered twice")
            names.add(route.name)
            if not route.languages:
                errors.append(f"{route.name} owns no language")
            if len(set(route.facts)) != len(route.facts):
                errors.append(f"{route.name} repeats a family")
            if route is not provider and route.fallbacks:
                errors.append(f"{route.name} is a fallback with fallbacks")
            if route is not provider and set(route.languages) != set(provider.languages):
                errors.append(f"{route.name} does not own what {provider.name} owns")
        for language in provider.languages:
            if language in owners:
                errors.append(f"{owners[language]} and {provider.name} both own {language}")
            owners.setdefault(language, provider.name)
    return errors


def select_providers(registry: list[Provider], languages: list[str], refused: dict[str, str], found: set[str], strict: bool = True) -> tuple[list[dict], list[str]]:
    """The route of each provider that is asked for and can run, with what comes after it; and warnings about the others.

    ``refused`` has a provider's reason not to run, ``found`` those whose tool is there.
    """
    if errors := registry_errors(registry):
        raise ValueError("; ".join(errors))
    if not strict:
        return [], ["strict providers stand down as asked; every language takes the generic lane"]
    chosen, warnings = [], []
    for provider in registry:
        owned = [x for x in provider.languages if x in languages]
        routes = []
        for route in (provider, *provider.fallbacks) if owned else ():
            if route.name in refused:
                warnings.append(refused[route.name])
            elif route.name not in found:
                warnings.append(f"{', '.join(owned)}: {route.name} was not found")
            else:
                routes.append(route.name)
        if routes:
            chosen.append({"provider": routes[0], "languages": owned, "fallbacks": routes[1:]})
    return chosen, warnings


def refresh_mode(before: dict | None, after: dict, changed: int, kept: int) -> str:
    """How a refresh came by its snapshot: initial, reload (another producer or universe), unchanged, incremental or rebuild."""
    if before is None:
        return "initial"
    if any(before.get(k) != after.get(k) for k in ("tool", "toolVersion", "universe")):
        return "reload"
    if not changed:
        return "unchanged"
    return "incremental" if kept else "rebuild"
