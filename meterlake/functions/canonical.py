"""Canonical provider, model and project identities as Column expressions.

Every function is idempotent on its own output, so it can be applied when events are written and again when they
are read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.functions.config import Config

# Routes that roll up to the company that serves them.
PROVIDER_ROUTES = {
    "openai-codex": "openai",
    "glm": "zai",
    "zai-coding-plan": "zai",
    "kimi": "moonshot",
    "kimi-coding": "moonshot",
    "kimi-for-coding": "moonshot",
    "moonshot-ai": "moonshot",
}

# Model-id prefixes that are spelled differently from the owner.
PREFIX_ROUTES = {"moonshotai": "moonshot"}

# Model families by owner: how an id begins, and what has to follow.
FAMILIES = (
    ("claude-", "", "anthropic"),
    ("glm-", "[0-9]", "zai"),
    ("kimi-k", "[0-9]", "moonshot"),
    ("gpt-", "[0-9]", "openai"),
    ("o", "[0-9]", "openai"),
    ("gemini-", "[0-9]", "google"),
    ("deepseek-", "", "deepseek"),
    ("grok-", "[0-9]|code", "x-ai"),
    ("minimax-", "", "minimax"),
    ("llama-", "[0-9]", "meta"),
    ("muse", "[-_]|$", "meta"),
)
FAMILY = "^(" + "|".join(f"{begin}(?={then})" for begin, then, _ in FAMILIES) + ")"

UNKNOWN = "unknown"


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def choose(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    """A small fixed lookup inside the expression: one literal map, so that the key is written once."""
    if not table:
        return otherwise
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), otherwise)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def canonical_provider(raw: Column | str) -> Column:
    """Null and the empty string have none; otherwise the trimmed lower-case id after the routes."""
    raw = column(raw)
    clean = F.lower(trimmed(raw))
    return F.when(F.coalesce(raw, F.lit("")) != "", choose(clean, PROVIDER_ROUTES, clean))


def routed_model(raw: Column | str) -> Column:
    """The model id without white space around it and without leading routing marks."""
    return F.regexp_replace(F.regexp_replace(column(raw), r"^\s*(~\s*)*", ""), r"\s+$", "")


def model_owner(raw: Column | str) -> Column:
    """The company behind a model, from the last segment of its id; null where no family matches."""
    family = F.regexp_extract(F.substring_index(F.lower(routed_model(raw)), "/", -1), FAMILY, 1)
    return choose(family, {begin: owner for begin, _, owner in FAMILIES}, F.lit(None).cast("string"))


def canonical_model(raw: Column | str, owner: Column | None = None) -> Column:
    """owner/model in lower case; the bare id where no owner is known; null for null or nothing.

    The id is written three times and the owner once, for these expressions nest: of owner/id the first segment goes if
    the id has one of its own, which may have another spelling.
    """
    clean = F.lower(routed_model(raw))
    owner = F.lower(F.coalesce(owner, model_owner(raw)) if owner is not None else model_owner(raw))
    segmented = F.regexp_replace(F.concat(owner, F.lit("/"), clean), "^[^/]*/(?=[^/]*/)", "")
    for prefix, other in PREFIX_ROUTES.items():
        segmented = F.regexp_replace(segmented, f"^{prefix}/", f"{other}/")
    return F.nullif(F.coalesce(segmented, clean), F.lit(""))


def merged_model(stored: Column | str) -> Column:
    """The canonical id at read time of a stored one; null counts as unknown, and unknown stays."""
    stored = F.coalesce(column(stored), F.lit(UNKNOWN))
    return F.coalesce(canonical_model(stored), stored)


def merged_provider(stored: Column | str) -> Column:
    """The canonical provider at read time of a stored one; null counts as unknown."""
    stored = F.coalesce(column(stored), F.lit(UNKNOWN))
    return F.coalesce(canonical_provider(stored), stored)


def pretty_model(display: Column, canonical: Column) -> Column:
    """A display that is more than the id wins; otherwise owner/owner-x is shown as owner-x."""
    base = F.coalesce(display, canonical)
    owner = F.lower(F.substring_index(canonical, "/", 1))
    family = F.substring(canonical, F.length(owner) + 2, 1 << 30)
    repeats = F.contains(canonical, F.lit("/")) & (F.length(owner) > 0) & F.startswith(F.lower(family), F.concat(owner, F.lit("-")))
    return F.when((F.lower(base) == F.lower(canonical)) & repeats, family).otherwise(base)


def model_display(raw: Column, canonical: Column) -> Column:
    return F.coalesce(F.when(raw != "", raw), canonical, F.lit(UNKNOWN))


def billing_mode(segment: Column, config: Config) -> Column:
    """The mode of a provider segment, as it is spelled or canonically; unspecified if the config names neither."""
    modes: dict[str, str] = {}
    for provider, mode in config.billing:
        modes.setdefault(provider.lower(), mode)
    lower = F.lower(segment)
    routed = choose(canonical_provider(lower), modes, F.lit("unspecified"))
    return choose(lower, modes, routed)


def owner_segment(model: Column | str) -> Column:
    return F.substring_index(column(model), "/", 1)


def project_name(path: Column | str) -> Column:
    """The last non-empty segment of a path with either slash; Unassigned without one."""
    parts = F.filter(F.split(F.translate(column(path), "\\", "/"), "/"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("Unassigned"))


def hash_id(namespace: str, key: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(namespace + ":"), column(key)), 256), 1, 16)


def normalised_path(path: Column | str, ignore_case: bool = True) -> Column:
    """One kind of slash, no trailing one, drive paths in lower case where the host does not tell case."""
    flat = F.regexp_replace(F.translate(column(path), "\\", "/"), r"(?<=[^/:])/+$", "")
    return F.lower(flat) if ignore_case else flat


def project_id(cwd: Column | str, config: Config) -> Column:
    """The id of the project that a directory belongs to, alias groups joined."""
    path = normalised_path(cwd, config.ignore_path_case)
    groups: dict[str, str] = {}
    for name, paths in config.project_aliases:
        for p in paths:
            flat = p.replace("\\", "/").rstrip("/")
            groups.setdefault(flat.lower() if config.ignore_path_case else flat, name)
    return F.when(F.coalesce(column(cwd), F.lit("")) != "", hash_id("project", choose(path, groups, path)))


def resolved(harness: Column, provider: Column, model: Column, at: Column, config: Config) -> dict[str, Column]:
    """Canonical provider and model of a record and how they were found.

    Provider: the first override that matches, else a route, else what the source says, else the model's owner.
    Model: an alias for the final provider, else the canonical id.
    """
    own, owner = canonical_provider(provider), model_owner(model)
    rules = []
    for o in config.overrides:
        test = harness == o.harness
        if o.raw_provider is not None:
            test &= F.lower(F.coalesce(provider, F.lit(""))) == o.raw_provider.lower()
        if o.raw_model is not None:
            test &= F.lower(F.coalesce(model, F.lit(""))) == o.raw_model.lower()
        if o.since:
            test &= at >= F.lit(o.since).cast("timestamp_ntz")
        if o.until:
            test &= at < F.lit(o.until).cast("timestamp_ntz")
        rules.append(F.when(test, F.lit(o.provider.lower())))
    chosen = F.coalesce(*rules) if rules else F.lit(None).cast("string")
    final = F.coalesce(chosen, own, owner)
    how = (
        F.when(chosen.isNotNull(), "user-override")
        .when(own.isNotNull() & (own != F.lower(provider)), "seed-alias")
        .when(own.isNotNull(), "source")
        .when(owner.isNotNull(), "model-owner")
        .otherwise(UNKNOWN)
    )
    clean = F.lower(routed_model(model))
    aliases = []
    for a in config.model_aliases:
        test = clean == a.model.lower()
        if a.provider is not None:
            test &= F.coalesce(final, F.lit("")) == a.provider.lower()
        aliases.append(F.when(test, F.lit(f"{a.owner.lower()}/{a.canonical.lower()}" if a.owner else a.canonical.lower())))
    return {"canonical_provider_id": final, "provider_resolution": how, "canonical_model_id": F.coalesce(*aliases, canonical_model(model)) if aliases else canonical_model(model)}
