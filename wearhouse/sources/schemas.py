"""The thirteen wardrobe tables as explicit Spark schemas plus key metadata.

The metadata (primary keys, NOT NULL columns, foreign keys, CHECK rules and
functional dependencies) feeds the audits in :mod:`wearhouse.operators.audit`
and the cascade order in :mod:`wearhouse.operators.changes`.
"""

from __future__ import annotations

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def _schema(*cols: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in cols])


L, S, I = LongType(), StringType(), IntegerType()

SCHEMAS: dict[str, StructType] = {
    "w_user": _schema(("u_id", L, False), ("username", S, False), ("gender", S, True), ("role", S, False)),
    "w_closet": _schema(("c_id", L, False), ("c_name", S, False), ("u_id", L, False)),
    "w_item": _schema(
        ("item_id", L, False), ("c_id", L, False), ("item_name", S, False), ("size", S, True), ("last_worn", S, True)
    ),
    "w_tag": _schema(("item_id", L, False), ("tag", S, False)),
    "w_cat": _schema(("item_id", L, False), ("category", S, False)),
    "w_color": _schema(("item_id", L, False), ("color", S, False)),
    "w_img": _schema(("item_id", L, False), ("image_url", S, False)),
    "w_outfit": _schema(
        ("outfit_id", L, False), ("u_id", L, False), ("outfit_name", S, False), ("note", S, True),
        ("created_date", S, False),
    ),
    "w_oimg": _schema(("outfit_id", L, False), ("image_url", S, False)),
    "w_season": _schema(("outfit_id", L, False), ("season", S, False)),
    "w_occ": _schema(("outfit_id", L, False), ("occasion", S, False)),
    "w_inc": _schema(("outfit_id", L, False), ("item_id", L, False)),
    "w_rec": _schema(
        ("outfit_id", L, False), ("datetime", S, False), ("rating", I, True), ("weather", S, True),
        ("note", S, True), ("mood", S, True),
    ),
}

TABLE_NAMES: tuple[str, ...] = tuple(SCHEMAS)

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "w_user": ("u_id",),
    "w_closet": ("c_id",),
    "w_item": ("item_id",),
    "w_tag": ("item_id", "tag"),
    "w_cat": ("item_id", "category"),
    "w_color": ("item_id", "color"),
    "w_img": ("item_id", "image_url"),
    "w_outfit": ("outfit_id",),
    "w_oimg": ("outfit_id", "image_url"),
    "w_season": ("outfit_id", "season"),
    "w_occ": ("outfit_id", "occasion"),
    "w_inc": ("outfit_id", "item_id"),
    "w_rec": ("outfit_id", "datetime"),
}

# UNIQUE constraints beyond the primary key.
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {"w_user": (("username",),)}

NOT_NULL: dict[str, tuple[str, ...]] = {
    name: tuple(f.name for f in schema.fields if not f.nullable) for name, schema in SCHEMAS.items()
}

# (child table, child column, parent table, parent column); every one cascades on delete.
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("w_closet", "u_id", "w_user", "u_id"),
    ("w_item", "c_id", "w_closet", "c_id"),
    ("w_tag", "item_id", "w_item", "item_id"),
    ("w_cat", "item_id", "w_item", "item_id"),
    ("w_color", "item_id", "w_item", "item_id"),
    ("w_img", "item_id", "w_item", "item_id"),
    ("w_outfit", "u_id", "w_user", "u_id"),
    ("w_oimg", "outfit_id", "w_outfit", "outfit_id"),
    ("w_season", "outfit_id", "w_outfit", "outfit_id"),
    ("w_occ", "outfit_id", "w_outfit", "outfit_id"),
    ("w_inc", "outfit_id", "w_outfit", "outfit_id"),
    ("w_inc", "item_id", "w_item", "item_id"),
    ("w_rec", "outfit_id", "w_outfit", "outfit_id"),
)

# The domains the schema and the application enforce.
ROLES = ("user", "manager", "admin")
SEASONS = ("Spring", "Summer", "Autumn", "Winter")
RATING_MIN, RATING_MAX = 1, 5
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp")

# CHECK constraints as SQL predicates; a CHECK passes when it evaluates to NULL.
CHECKS: dict[str, tuple[tuple[str, str], ...]] = {
    "w_user": (("role_domain", "role IN ('user', 'manager', 'admin')"),),
    "w_rec": (("rating_range", "rating IS NULL OR rating BETWEEN 1 AND 5"),),
}

# Functional dependencies X -> Y stated for the design (key -> attributes).
FUNCTIONAL_DEPENDENCIES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("w_user", ("u_id",), ("username", "gender", "role")),
    ("w_user", ("username",), ("u_id",)),
    ("w_closet", ("c_id",), ("c_name", "u_id")),
    ("w_item", ("item_id",), ("c_id", "item_name", "size", "last_worn")),
    ("w_outfit", ("outfit_id",), ("u_id", "outfit_name", "note", "created_date")),
    ("w_rec", ("outfit_id", "datetime"), ("rating", "weather", "note", "mood")),
)
