"""What the engine knows of an entity table."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EntitySpec:
    """key: the id column. text_fields: indexed columns in order; the first weighs FIRST_WEIGHT in a rank. stored: columns that aren't indexed.

    get_keys: columns that get() takes, in order; of several, the last given one decides. filters: filter() argument to column.
    weights: column to weight in a fuzzy search. order_fields: columns that break ties of its scores, highest first.
    """

    name: str
    text_fields: tuple[str, ...]
    key: str = "id"
    stored: tuple[str, ...] = ()
    get_keys: tuple[str, ...] = ("id",)
    filters: dict[str, str] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    order_fields: tuple[str, ...] = ()


COUNTRIES = EntitySpec(
    "countries",
    ("name", "official_name", "alpha2", "alpha3", "numeric", "alt_names"),
    stored=("flag",),
    get_keys=("id", "alpha2", "alpha3", "numeric"),
    filters={"name": "name", "official_name": "official_name", "alt_name": "alt_names"},
    weights={"name": 1.0, "official_name": 1.0, "alt_names": 1.0},
)
SUBDIVISIONS = EntitySpec(
    "subdivisions",
    ("name", "alt_names", "type", "geonames_code", "iso_code", "country", "parent_id"),
    get_keys=("id", "iso_code", "geonames_code"),
    filters={"name": "name", "type": "type", "country": "country", "alt_name": "alt_names"},
    weights={"name": 1.0, "alt_names": 0.4, "country": 0.33},
)
CITIES = EntitySpec(
    "cities",
    ("name", "geonames_id", "admin1", "admin2", "country", "alt_names"),
    stored=("population", "lat", "lng"),
    get_keys=("id", "geonames_id"),
    filters={"name": "name", "admin1": "admin1", "admin2": "admin2", "country": "country", "alt_name": "alt_names"},
    weights={"name": 1.0, "alt_names": 1.5, "admin1": 0.2, "admin2": 0.1, "country": 0.2},
    order_fields=("population",),
)
