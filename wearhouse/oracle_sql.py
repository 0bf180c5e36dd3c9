"""Independent DuckDB SQL for every registered query.

Each statement first derives the thirteen wardrobe tables from the TPC-H-style
views with the same rules as :mod:`wearhouse.sources.derive`, then computes the
query's result from its meaning: one subquery per attribute, one relation per
thing counted, searches over the combinations of an item's values.  Constraint
lists are written here on their own, so a wrong list in the library shows.
"""

from __future__ import annotations

DERIVE = r"""
WITH
w_user AS (
    SELECT CAST(r_regionkey AS BIGINT) AS u_id, r_name AS username, CAST(NULL AS VARCHAR) AS gender,
           CASE WHEN r_regionkey = 0 THEN 'manager' ELSE 'user' END AS role
    FROM region
    UNION ALL SELECT CAST(99 AS BIGINT), 'NOBODY', '', 'admin'
),
w_closet AS (
    SELECT CAST(n_nationkey AS BIGINT) AS c_id, n_name AS c_name, CAST(n_regionkey AS BIGINT) AS u_id FROM nation
),
w_item AS (
    SELECT p.p_partkey AS item_id,
           CAST(regexp_extract(p.p_brand, 'Brand#(\d+)', 1) AS BIGINT) - 1 AS c_id,
           p.p_name AS item_name,
           CAST(p.p_size AS VARCHAR) AS size,
           CASE WHEN p.p_partkey % 10 = 0 THEN NULL
                WHEN p.p_partkey % 10 = 1 THEN ''
                ELSE strftime(f.first_ship, '%Y-%m-%d') END AS last_worn
    FROM part p
    LEFT JOIN (SELECT l_partkey, MIN(l_shipdate) AS first_ship FROM lineitem GROUP BY l_partkey) f
      ON p.p_partkey = f.l_partkey
),
w_tag AS (
    SELECT DISTINCT item_id, tag FROM (
        SELECT p_partkey AS item_id, unnest(string_split(p_name, ' ')) AS tag FROM part) x
),
w_cat AS (
    SELECT p_partkey AS item_id, p_type AS category FROM part WHERE p_type <> 'PROMO'
    UNION ALL
    SELECT p_partkey AS item_id, 'OVERSIZE' AS category FROM part WHERE p_size >= 45
),
w_color AS (
    SELECT item_id, color FROM (
        SELECT p_partkey AS item_id,
               CASE WHEN starts_with(p_name, 'red') THEN 'Red'
                    WHEN starts_with(p_name, 'blue') THEN 'Blue'
                    WHEN starts_with(p_name, 'green') THEN 'Green' END AS color
        FROM part) x
    WHERE color IS NOT NULL
),
w_img AS (
    SELECT p_partkey AS item_id, '/img/p' || CAST(p_partkey AS VARCHAR) || '.png' AS image_url
    FROM part WHERE p_partkey % 3 = 0
),
w_outfit AS (
    SELECT o.o_orderkey AS outfit_id, CAST(n.n_regionkey AS BIGINT) AS u_id,
           'Outfit ' || CAST(o.o_orderkey AS VARCHAR) AS outfit_name,
           o.o_orderpriority AS note,
           strftime(o.o_orderdate, '%Y-%m-%d') AS created_date
    FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
),
w_oimg AS (
    SELECT o_orderkey AS outfit_id,
           CASE WHEN o_orderkey % 4 = 0 THEN '/img/o' || CAST(o_orderkey AS VARCHAR) || '.png' ELSE '' END AS image_url
    FROM orders WHERE o_orderkey % 4 <= 1
),
w_season AS (
    SELECT o_orderkey AS outfit_id,
           CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'Spring'
                WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'Summer'
                WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'Autumn'
                ELSE 'Winter' END AS season
    FROM orders
    UNION
    SELECT o_orderkey, 'Summer' FROM orders WHERE o_orderkey % 5 = 0
    UNION
    SELECT o_orderkey, 'Monsoon' FROM orders WHERE o_orderkey % 101 = 0
),
w_occ AS (
    SELECT o_orderkey AS outfit_id, o_orderstatus AS occasion FROM orders
    UNION
    SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0
),
w_inc AS (
    SELECT DISTINCT l_orderkey AS outfit_id, l_partkey AS item_id FROM lineitem
),
w_rec AS (
    SELECT l_orderkey AS outfit_id,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS datetime,
           CAST(CASE WHEN l_linenumber <= 5 THEN l_linenumber END AS INTEGER) AS rating,
           l_returnflag AS weather,
           CAST(NULL AS VARCHAR) AS note,
           l_linestatus AS mood
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_shipdate ORDER BY l_linenumber, l_partkey) AS rn
          FROM lineitem) x
    WHERE rn = 1
)
"""

_Q: dict[str, str] = {}


def q(name: str, body: str) -> None:
    """Register ``body``: more CTEs (starting with ',') and/or a final SELECT."""
    _Q[name] = body


def all_sql() -> dict[str, str]:
    return {name: DERIVE + body for name, body in _Q.items()}


# ---------------------------------------------------------------- shared pieces
def _text(child: str, column: str, key: str, of: str) -> str:
    """The distinct values of one row's child table as sorted comma text."""
    return f"(SELECT string_agg(DISTINCT {column}, ',' ORDER BY {column}) FROM {child} WHERE {child}.{key} = {of}.{key}) AS {column}"


#: Wears of an item: every record of every outfit that holds it.
_WORN = """
, worn AS (
    SELECT item_id, count(*) AS wears, max(datetime) AS latest FROM w_inc JOIN w_rec USING (outfit_id) GROUP BY item_id
)
"""

#: One line per item and category, 'Uncategorized' where there is none.
_FILED = """
, filed AS (
    SELECT item_id, category FROM w_cat
    UNION ALL SELECT item_id, 'Uncategorized' FROM w_item WHERE item_id NOT IN (SELECT item_id FROM w_cat)
)
"""

#: All combinations of an item's tag, category and color ('' where it has none).
_COMBINED = """
, combined AS (
    SELECT item_id, COALESCE(tag, '') AS t, COALESCE(category, '') AS k, COALESCE(color, '') AS c
    FROM w_item LEFT JOIN w_tag USING (item_id) LEFT JOIN w_cat USING (item_id) LEFT JOIN w_color USING (item_id)
)
"""

# ------------------------------------------------------------------ reports
_USAGE = _WORN + f"""
, usage AS (
    SELECT owner.u_id, item.item_id, item.item_name, item.last_worn, COALESCE(worn.wears, 0) AS wear_count,
           {_text('w_cat', 'category', 'item_id', 'item')},
           {_text('w_color', 'color', 'item_id', 'item')}
    FROM w_item AS item JOIN w_closet AS owner USING (c_id) LEFT JOIN worn USING (item_id)
)
"""


def _ranked(sign: str) -> str:
    return f"row_number() OVER (PARTITION BY u_id ORDER BY {sign}wear_count, last_worn NULLS FIRST, item_name, item_id)"


for _name, _sign in (("report_most_worn", "-"), ("report_least_worn", "")):
    q(_name, _USAGE + f"SELECT u_id, item_id, item_name, category, color, last_worn, wear_count FROM usage QUALIFY {_ranked(_sign)} <= 5")
q("report_most_worn_user", _USAGE + f"""
SELECT u_id, item_id, item_name, category, color, last_worn, wear_count FROM usage WHERE u_id = 1 QUALIFY {_ranked('-')} <= 5
""")

_TOTALS = """
, things AS (
    SELECT u_id, 'closet' AS thing FROM w_closet
    UNION ALL SELECT u_id, 'item' FROM w_closet JOIN w_item USING (c_id)
    UNION ALL SELECT u_id, 'outfit' FROM w_outfit
    UNION ALL SELECT u_id, 'record' FROM w_outfit JOIN w_rec USING (outfit_id)
)
, totals AS (
    SELECT who.u_id, count(*) FILTER (thing = 'closet') AS closet_count, count(*) FILTER (thing = 'item') AS item_count,
           count(*) FILTER (thing = 'outfit') AS outfit_count, count(*) FILTER (thing = 'record') AS record_count
    FROM w_user AS who LEFT JOIN things ON things.u_id = who.u_id GROUP BY who.u_id
)
"""
q("report_totals", _TOTALS + "SELECT * FROM totals")
_CATEGORIES = _FILED + """
, per_category AS (
    SELECT u_id, category, count(*) AS item_count FROM filed JOIN w_item USING (item_id) JOIN w_closet USING (c_id) GROUP BY u_id, category
)
"""
q("report_category_counts", _CATEGORIES + "SELECT * FROM per_category")
q("category_counts_all", _FILED + "SELECT category, count(*) AS item_count FROM filed GROUP BY category")

_REUSE = """
, times AS (SELECT outfit_id, count(*) AS worn_times, max(datetime) AS last_recorded FROM w_rec GROUP BY outfit_id)
, reuse AS (
    SELECT u_id, outfit_id, outfit_name, COALESCE(worn_times, 0) AS worn_times, last_recorded,
           row_number() OVER (PARTITION BY u_id ORDER BY COALESCE(worn_times, 0) DESC, created_date DESC, outfit_id DESC) AS place
    FROM w_outfit LEFT JOIN times USING (outfit_id)
)
"""
q("report_outfit_reuse", _REUSE + "SELECT u_id, outfit_id, outfit_name, worn_times, last_recorded FROM reuse WHERE place <= 5")

q("items_joined", _COMBINED + """
SELECT username, c_name AS closet_name, item_name, size, k AS category, c AS color, t AS tag, last_worn
FROM combined JOIN w_item USING (item_id) JOIN w_closet USING (c_id) JOIN w_user USING (u_id)
""")

q("outfits_min_items", """
, sizes AS (SELECT outfit_id, count(*) AS pieces FROM w_inc GROUP BY ALL)
SELECT outfit_id, outfit_name, created_date FROM sizes JOIN w_outfit USING (outfit_id) WHERE pieces > 2
""")

q("item_usage_all", _WORN + """
SELECT item_id, item_name, COALESCE(wears, 0) AS wear_count, latest AS last_recorded FROM w_item LEFT JOIN worn USING (item_id)
""")

q("admin_users", _TOTALS + """
SELECT u_id, username, COALESCE(gender, '') AS gender, role, closet_count, item_count FROM totals JOIN w_user USING (u_id)
""")

q("accounts", "SELECT username FROM w_user")
q("user_count", "SELECT count(*) AS user_count FROM w_user")
q("user_roles", "SELECT u_id, username, role FROM w_user")
q("gender_labels", "SELECT u_id, username, CASE WHEN length(gender) > 0 THEN gender ELSE 'not set' END AS gender_label FROM w_user")

# ------------------------------------------------------------------ catalog
_CATALOG = f"""
, catalog AS (
    SELECT item.item_id, item.c_id, owner.u_id, item.item_name, item.size, item.last_worn, owner.c_name,
           {_text('w_tag', 'tag', 'item_id', 'item')},
           {_text('w_cat', 'category', 'item_id', 'item')},
           {_text('w_color', 'color', 'item_id', 'item')},
           {_text('w_img', 'image_url', 'item_id', 'item')}
    FROM w_item AS item JOIN w_closet AS owner USING (c_id)
)
"""


def _found(test: str) -> str:
    """Items some of whose combinations pass ``test``, showing only the values
    of the passing ones (and all images)."""
    shown = ", ".join(f"string_agg(DISTINCT {c}, ',' ORDER BY {c}) FILTER ({c} <> '') AS {n}" for c, n in (("t", "tag"), ("k", "category"), ("c", "color")))
    return _CATALOG + _COMBINED + f"""
, hits AS (
    SELECT item_id, {shown}
    FROM combined JOIN (SELECT item_id, u_id, item_name, COALESCE(size, '') AS s FROM catalog) USING (item_id) WHERE {test} GROUP BY item_id
)
SELECT item_id, c_id, u_id, item_name, size, last_worn, c_name, hits.tag, hits.category, hits.color, image_url
FROM hits JOIN (SELECT item_id, c_id, u_id, item_name, size, last_worn, c_name, image_url FROM catalog) USING (item_id)
"""


def _keyword(word: str) -> str:
    return " OR ".join(f"{c} ILIKE '%{word}%'" for c in ("item_name", "t", "k", "c", "s"))


CAT_COLS = "item_id, c_id, u_id, item_name, size, last_worn, c_name, tag, category, color, image_url"

q("closets", "SELECT c_id, c_name, u_id FROM w_closet")
q("item_catalog", _CATALOG + f"SELECT {CAT_COLS} FROM catalog")
q("items_by_closet", _CATALOG + f"SELECT {CAT_COLS} FROM catalog WHERE c_id = 3")
q("search_keyword", _found(_keyword("re")))
q("search_wildcard", _found(_keyword("r_d")))
q("search_category_keyword", _found(_keyword("econ")))
for _name, _word in (("search_keyword_indexed", "re"), ("search_wildcard_indexed", "r_d"), ("search_category_indexed", "econ")):
    q(_name, _found(_keyword(_word)))
q("search_letter_indexed", _found(f"k = 'LARGE' AND ({_keyword('g%z')})"))
q("search_tag", _found("t = 'hot'"))
q("search_combined", _found(f"u_id = 1 AND k = 'LARGE' AND c = 'Blue' AND ({_keyword('ge')})"))
q("search_unworn_first", _CATALOG + f"""
SELECT {CAT_COLS}, row_number() OVER (PARTITION BY u_id ORDER BY last_worn <> '' AND last_worn IS NOT NULL, last_worn NULLS FIRST, item_name, item_id) AS position
FROM catalog QUALIFY position <= 5
""")

_REQ = """
, possessions AS (SELECT u_id, item_id FROM w_closet JOIN w_item USING (c_id))
, req AS (SELECT outfit_id, u_id, item_id FROM w_outfit JOIN w_inc USING (outfit_id))
"""
q("owned_items", _REQ + "SELECT * FROM req SEMI JOIN possessions USING (u_id, item_id)")
q("ownership_violations", _REQ + "SELECT * FROM req ANTI JOIN possessions USING (u_id, item_id)")
q("item_outfit_refs", "SELECT item_id, u_id, count(*) AS outfit_count FROM w_inc JOIN w_outfit USING (outfit_id) GROUP BY ALL")
q("closet_outfit_refs", """
, used AS (SELECT DISTINCT c_id, outfit_id FROM w_item JOIN w_inc USING (item_id))
SELECT c_id, count(outfit_id) AS outfit_count FROM w_closet LEFT JOIN used USING (c_id) GROUP BY c_id
""")
q("facet_options", """
, valued AS (
    SELECT item_id, 'tags' AS facet, tag AS value FROM w_tag
    UNION ALL SELECT item_id, 'colors', color FROM w_color
    UNION ALL SELECT item_id, 'categories', category FROM w_cat
)
SELECT DISTINCT u_id, facet, value FROM valued JOIN w_item USING (item_id) JOIN w_closet USING (c_id) WHERE length(value) > 0
""")


def _first(c: str) -> str:
    """C2 in DuckDB: first trimmed non-blank comma part, else ''."""
    return f"COALESCE(list_filter(list_transform(string_split(COALESCE({c}, ''), ','), lambda x: trim(x)), lambda x: x <> '')[1], '')"


_HAY = "lower(concat_ws(' ', item_name, category, color, tag))"
q("picker_filter", _CATALOG + f"SELECT {CAT_COLS} FROM catalog WHERE {_first('category')} = 'SMALL' AND contains({_HAY}, 'old')")
q("picker_filter_closet", _CATALOG + f"SELECT {CAT_COLS} FROM catalog WHERE c_id = 7 AND contains({_HAY}, 'ge')")
q("item_labels", _CATALOG + f"""
SELECT item_id, u_id, item_name,
       COALESCE(NULLIF({_first('category')}, ''), NULLIF({_first('tag')}, ''), 'Item') AS type_label,
       {_first('image_url')} AS image,
       COALESCE(NULLIF({_first('color')}, ''), 'No color') AS color_label,
       COALESCE(NULLIF(size, ''), 'No size') AS size_label,
       COALESCE(NULLIF(last_worn, ''), 'Not recorded') AS last_worn_label
FROM catalog
""")
q("primary_category_facet", _CATALOG + f"SELECT DISTINCT u_id, {_first('category')} AS category FROM catalog WHERE {_first('category')} <> ''")


# ------------------------------------------------------------------ outfits
_OUTFIT_LIST = f"""
, olist AS (
    SELECT o.outfit_id, o.u_id, o.outfit_name, o.note, o.created_date,
           {_text('w_season', 'season', 'outfit_id', 'o')},
           {_text('w_occ', 'occasion', 'outfit_id', 'o')},
           {_text('w_oimg', 'image_url', 'outfit_id', 'o')},
           pieces.item_names, COALESCE(own.image, pieces.image) AS preview_image, COALESCE(pieces.n, 0) AS item_count,
           COALESCE(wears.n, 0) AS worn_count, wears.latest AS last_worn
    FROM w_outfit AS o
    LEFT JOIN (SELECT outfit_id, min(image_url) AS image FROM w_oimg WHERE image_url <> '' GROUP BY ALL) AS own USING (outfit_id)
    LEFT JOIN (
        SELECT outfit_id, string_agg(DISTINCT item_name, ',' ORDER BY item_name) AS item_names, count(*) AS n, min(image) AS image
        FROM w_inc JOIN w_item USING (item_id)
        LEFT JOIN (SELECT item_id, min(image_url) AS image FROM w_img WHERE image_url <> '' GROUP BY ALL) AS shot USING (item_id)
        GROUP BY outfit_id
    ) AS pieces USING (outfit_id)
    LEFT JOIN (SELECT outfit_id, count(*) AS n, max(datetime) AS latest FROM w_rec GROUP BY ALL) AS wears USING (outfit_id)
)
"""
OL_COLS = ("outfit_id, u_id, outfit_name, note, created_date, season, occasion, image_url, item_names, "
           "preview_image, item_count, worn_count, last_worn")
q("outfit_list", _OUTFIT_LIST + f"SELECT {OL_COLS} FROM olist")
q("outfit_list_user", _OUTFIT_LIST + f"SELECT {OL_COLS} FROM olist WHERE u_id = 1")

_DETAIL = _OUTFIT_LIST + """
, links AS (SELECT outfit_id, list(item_id ORDER BY item_id) AS ids FROM w_inc GROUP BY outfit_id)
, detail AS (
    SELECT olist.* EXCLUDE (item_names, preview_image, item_count), COALESCE(len(ids), 0) AS item_count, ids
    FROM olist LEFT JOIN links USING (outfit_id)
)
"""
D_COLS = "outfit_id, u_id, outfit_name, note, created_date, season, occasion, image_url, item_count, worn_count, last_worn"
q("outfit_detail", _DETAIL + f"SELECT {D_COLS}, array_to_string(ids, ',') AS item_ids FROM detail")
q("outfit_items", _CATALOG + f"SELECT outfit_id, {CAT_COLS} FROM w_inc JOIN catalog USING (item_id)")

_VALUES = "list_filter(list_transform(string_split(COALESCE({c}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
q("outfit_filter", _OUTFIT_LIST + f"""
SELECT {OL_COLS} FROM olist
WHERE contains(lower(concat_ws(' ', outfit_name, note, item_names)), 'outfit 1')
  AND list_contains({_VALUES.format(c='season')}, 'Summer')
  AND list_contains({_VALUES.format(c='occasion')}, '1-URGENT')
""")

q("outfit_cards", _OUTFIT_LIST + f"""
SELECT outfit_id, u_id, outfit_name,
       CASE WHEN len({_VALUES.format(c='season')}) > 0 THEN array_to_string({_VALUES.format(c='season')}, ',')
            ELSE 'Any season' END AS season_label,
       array_to_string({_VALUES.format(c='occasion')}, ',') AS occasion_label,
       array_to_string(list_slice({_VALUES.format(c='item_names')}, 1, 3), ', ') AS visible_items,
       CAST(greatest(0, COALESCE(NULLIF(item_count, 0), len({_VALUES.format(c='item_names')}))
            - len(list_slice({_VALUES.format(c='item_names')}, 1, 3))) AS BIGINT) AS more_items,
       COALESCE(NULLIF({_first('preview_image')}, ''), {_first('image_url')}) AS image,
       worn_count AS times_worn,
       COALESCE(NULLIF(last_worn, ''), 'Never') AS last_worn_label
FROM olist
""")

q("season_facet", """
, canon AS (SELECT * FROM (VALUES (1, 'Spring'), (2, 'Summer'), (3, 'Autumn'), (4, 'Winter')) v(position, season))
, extra AS (
    SELECT DISTINCT u_id, trim(season) AS season FROM w_season JOIN w_outfit USING (outfit_id)
    WHERE trim(season) NOT IN (SELECT season FROM canon) AND trim(season) <> ''
)
SELECT u_id, CAST(position AS BIGINT) AS position, season FROM w_user, canon
UNION ALL
SELECT u_id, CAST(4 + row_number() OVER (PARTITION BY u_id ORDER BY season) AS BIGINT), season FROM extra
""")

q("occasion_facet", "SELECT DISTINCT u_id, trim(occasion) AS occasion FROM w_occ JOIN w_outfit USING (outfit_id) WHERE trim(occasion) <> ''")

# ------------------------------------------------------------------ history
_HISTORY = _DETAIL + """
, hist AS (
    SELECT outfit_id, u_id, datetime, weather, mood, rating, w_rec.note, outfit_name, season, occasion, item_count
    FROM w_rec JOIN (SELECT outfit_id, u_id, outfit_name, season, occasion, item_count FROM detail) USING (outfit_id)
)
"""
q("wear_history", _HISTORY + "SELECT * FROM hist")
q("wear_history_user", _HISTORY + "SELECT * FROM hist WHERE u_id = 1")
q("recent_records", _HISTORY + "SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY u_id ORDER BY datetime DESC, outfit_id) <= 5")


# The dashboard: six lists as one relation of labelled values.
_MOST, _LEAST = _ranked("-"), _ranked("")
q("report_overview", _USAGE + _TOTALS + _CATEGORIES + _REUSE + _HISTORY + f"""
, placed_history AS (SELECT *, row_number() OVER (PARTITION BY u_id ORDER BY datetime DESC, outfit_id) AS place FROM hist)
SELECT 'totals' AS report, u_id, unnest([1, 2, 3, 4])::BIGINT AS position, unnest(['closet_count', 'item_count', 'outfit_count', 'record_count']) AS label,
       unnest([closet_count, item_count, outfit_count, record_count])::BIGINT AS value FROM totals
UNION ALL SELECT 'categories', u_id, row_number() OVER (PARTITION BY u_id ORDER BY item_count DESC, category), category, item_count FROM per_category
UNION ALL SELECT 'most_worn', u_id, place, item_name, wear_count FROM (SELECT *, {_MOST} AS place FROM usage) WHERE place <= 5
UNION ALL SELECT 'least_worn', u_id, place, item_name, wear_count FROM (SELECT *, {_LEAST} AS place FROM usage) WHERE place <= 5
UNION ALL SELECT 'reuse', u_id, place, outfit_name, worn_times FROM reuse WHERE place <= 5
UNION ALL SELECT 'recent', u_id, place, datetime || ' ' || outfit_name, rating FROM placed_history WHERE place <= 5
""")


# ------------------------------------------------------------------ audits
# The constraints of the data model, written down here on their own.
_KEYS = (
    ("w_user", "u_id"), ("w_closet", "c_id"), ("w_item", "item_id"), ("w_tag", "item_id,tag"), ("w_cat", "item_id,category"),
    ("w_color", "item_id,color"), ("w_img", "item_id,image_url"), ("w_outfit", "outfit_id"), ("w_oimg", "outfit_id,image_url"),
    ("w_season", "outfit_id,season"), ("w_occ", "outfit_id,occasion"), ("w_inc", "outfit_id,item_id"), ("w_rec", "outfit_id,datetime"),
    ("w_user", "username"),
)
_REQUIRED = (
    ("w_user", "u_id username role"), ("w_closet", "c_id c_name u_id"), ("w_item", "item_id c_id item_name"), ("w_tag", "item_id tag"),
    ("w_cat", "item_id category"), ("w_color", "item_id color"), ("w_img", "item_id image_url"),
    ("w_outfit", "outfit_id u_id outfit_name created_date"), ("w_oimg", "outfit_id image_url"), ("w_season", "outfit_id season"),
    ("w_occ", "outfit_id occasion"), ("w_inc", "outfit_id item_id"), ("w_rec", "outfit_id datetime"),
)
_DOMAINS = (
    ("w_user", "role_domain", "role NOT IN ('user', 'manager', 'admin')"),
    ("w_rec", "rating_range", "rating < 1 OR rating > 5"),
)
_PARENTS = (
    ("w_closet", "u_id", "w_user"), ("w_item", "c_id", "w_closet"), ("w_tag", "item_id", "w_item"), ("w_cat", "item_id", "w_item"),
    ("w_color", "item_id", "w_item"), ("w_img", "item_id", "w_item"), ("w_outfit", "u_id", "w_user"), ("w_oimg", "outfit_id", "w_outfit"),
    ("w_season", "outfit_id", "w_outfit"), ("w_occ", "outfit_id", "w_outfit"), ("w_inc", "outfit_id", "w_outfit"), ("w_inc", "item_id", "w_item"),
    ("w_rec", "outfit_id", "w_outfit"),
)
_DEPENDENT = (
    ("w_user", "u_id", "username,gender,role"), ("w_user", "username", "u_id"), ("w_closet", "c_id", "c_name,u_id"),
    ("w_item", "item_id", "c_id,item_name,size,last_worn"), ("w_outfit", "outfit_id", "u_id,outfit_name,note,created_date"),
    ("w_rec", "outfit_id,datetime", "rating,weather,note,mood"),
)


def _all_of(parts) -> str:
    return "\n" + "\nUNION ALL\n".join(parts)


q("audit_pk", _all_of(
    f"SELECT '{t}' AS table_name, '{k}' AS key_columns, CAST(COALESCE(sum(n), 0) AS BIGINT) AS n_rows, count(*) AS distinct_keys, "
    f"count(*) FILTER (n > 1) AS dup_keys FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})" for t, k in _KEYS))
q("audit_not_null", _all_of(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count FROM {t}" for t, cs in _REQUIRED for c in cs.split()))
q("audit_check", _all_of(f"SELECT '{t}' AS table_name, '{n}' AS check_name, count(*) AS violations FROM {t} WHERE {bad}" for t, n, bad in _DOMAINS))
q("audit_fk", _all_of(
    f"SELECT '{t}' AS child_table, '{c}' AS child_column, '{p}' AS parent_table, count(*) AS orphan_rows FROM {t} ANTI JOIN {p} USING ({c}) WHERE {c} IS NOT NULL"
    for t, c, p in _PARENTS))
q("audit_fd", _all_of(
    f"SELECT '{t}' AS table_name, '{x}' AS determinant, '{y}' AS dependent, count(*) AS violations "
    f"FROM (SELECT 1 FROM (SELECT DISTINCT {x},{y} FROM {t}) GROUP BY {x.replace(',', ', ')} HAVING count(*) > 1)" for t, x, y in _DEPENDENT))

q("audit_ownership", """
, owners AS (SELECT item_id, u_id AS item_owner FROM w_item JOIN w_closet USING (c_id))
SELECT outfit_id, item_id, u_id AS outfit_owner, item_owner
FROM w_inc JOIN w_outfit USING (outfit_id) LEFT JOIN owners USING (item_id) WHERE u_id IS DISTINCT FROM item_owner
""")
q("audit_season", "SELECT outfit_id, season FROM w_season WHERE season NOT IN ('Spring', 'Summer', 'Autumn', 'Winter')")

q("report_rows", _USAGE + _CATEGORIES + f"""
, lists AS (
    SELECT u_id, 'categoryReport' AS report, row_number() OVER (PARTITION BY u_id ORDER BY item_count DESC, category) AS position,
           category AS label, item_count || ' items' AS value_text
    FROM per_category
    UNION ALL SELECT u_id, 'mostWornReport', {_ranked('-')}, item_name, wear_count || ' wears' FROM usage
    UNION ALL SELECT u_id, 'leastWornReport', {_ranked('')}, item_name, wear_count || ' wears' FROM usage
)
, names AS (SELECT unnest(['categoryReport', 'mostWornReport', 'leastWornReport']) AS report)
SELECT u_id, report, CAST(COALESCE(position, 1) AS BIGINT) AS position,
       CASE WHEN position IS NULL THEN 'No data' WHEN label = '' THEN 'Untitled' ELSE label END AS label, COALESCE(value_text, '-') AS value_text
FROM (SELECT u_id, report FROM w_user, names) LEFT JOIN lists USING (u_id, report)
WHERE report = 'categoryReport' OR position IS NULL OR position <= 5
""")


# ------------------------------------------------------------------ change sets
TABLES = ("w_user", "w_closet", "w_item", "w_tag", "w_cat", "w_color", "w_img",
          "w_outfit", "w_oimg", "w_season", "w_occ", "w_inc", "w_rec")


def _counts(filters: dict[str, str], extra: dict[str, str] | None = None, rejects: str = "SELECT 0") -> str:
    """Table counts after a change: ``filters`` maps a table to a WHERE clause,
    ``extra`` to a count of added rows."""
    parts = []
    for n in TABLES:
        where = f" WHERE {filters[n]}" if n in filters else ""
        add = f" + ({extra[n]})" if extra and n in extra else ""
        parts.append(f"SELECT '{n}' AS table_name, CAST((SELECT COUNT(*) FROM {n}{where}){add} AS BIGINT) AS n_rows")
    parts.append(f"SELECT 'rejects', CAST(({rejects}) AS BIGINT)")
    return "\nUNION ALL\n".join(parts)


q("touch_worn", """
, d AS (SELECT item_id, left(max(datetime), 10) AS day FROM w_inc JOIN w_rec USING (outfit_id) GROUP BY item_id)
SELECT item_id, COALESCE(greatest(NULLIF(last_worn, ''), day), last_worn) AS last_worn FROM w_item LEFT JOIN d USING (item_id)
""")

_OREQ = """
, first_item AS (SELECT outfit_id, MIN(item_id) AS item_id FROM w_inc GROUP BY outfit_id)
, item_owner AS (SELECT I.item_id, C.u_id FROM w_item I JOIN w_closet C ON I.c_id = C.c_id)
, oreq AS (
    SELECT O.outfit_id, COALESCE(IO.u_id, O.u_id) AS u_id, O.u_id AS owner
    FROM w_outfit O
    LEFT JOIN first_item FI ON O.outfit_id = FI.outfit_id
    LEFT JOIN item_owner IO ON FI.item_id = IO.item_id
)
, odel AS (SELECT outfit_id FROM oreq WHERE u_id = owner)
"""
_ODEL = "outfit_id NOT IN (SELECT outfit_id FROM odel)"
q("cascade_delete_outfits", _OREQ + _counts(
    {n: _ODEL for n in ("w_outfit", "w_oimg", "w_season", "w_occ", "w_inc", "w_rec")},
    rejects="SELECT COUNT(*) FROM oreq WHERE u_id <> owner",
))

_IREQ = """
, req AS (SELECT I.item_id AS change_id, C.u_id, I.item_id FROM w_item I JOIN w_closet C ON I.c_id = C.c_id )
, refs AS (SELECT N.item_id, O.u_id, COUNT(DISTINCT N.outfit_id) AS n
           FROM w_inc N JOIN w_outfit O ON N.outfit_id = O.outfit_id GROUP BY N.item_id, O.u_id)
, outc AS (
    SELECT req.change_id, req.item_id, req.u_id,
           CASE WHEN COALESCE(refs.n, 0) > 0
                THEN 'This item is used by ' || CAST(refs.n AS VARCHAR) || ' outfit(s). Update or delete those outfits first.'
                ELSE 'deleted' END AS outcome
    FROM req LEFT JOIN refs ON refs.item_id = req.item_id AND refs.u_id = req.u_id
)
"""
q("delete_items_restricted", _IREQ + "SELECT change_id, item_id, u_id, outcome FROM outc")
_IDEL = "item_id NOT IN (SELECT item_id FROM outc WHERE outcome = 'deleted')"
q("delete_items_tables", _IREQ + _counts(
    {n: _IDEL for n in ("w_item", "w_tag", "w_cat", "w_color", "w_img", "w_inc")},
    rejects="SELECT COUNT(*) FROM outc WHERE outcome <> 'deleted'",
))

_LISTS = """
, olists AS (
    SELECT O.outfit_id, O.u_id, O.outfit_name, O.note, O.created_date,
           (SELECT string_agg(DISTINCT S.season, ',' ORDER BY S.season) FROM w_season S WHERE S.outfit_id = O.outfit_id) AS season,
           (SELECT string_agg(DISTINCT A.occasion, ',' ORDER BY A.occasion) FROM w_occ A WHERE A.outfit_id = O.outfit_id) AS occasion,
           (SELECT string_agg(DISTINCT G.image_url, ',' ORDER BY G.image_url) FROM w_oimg G WHERE G.outfit_id = O.outfit_id) AS image_url,
           COALESCE((SELECT list_sort(list_distinct(list(N.item_id))) FROM w_inc N WHERE N.outfit_id = O.outfit_id), []) AS ids
    FROM w_outfit O
)
, owned AS (SELECT I.item_id, C.u_id FROM w_item I JOIN w_closet C ON I.c_id = C.c_id)
"""
_SEASON_ERR = ("list_bool_or(list_transform(list_filter(list_transform(string_split(COALESCE({c}, ''), ','), "
               "lambda x: trim(x)), lambda x: x <> ''), lambda x: lower(x) NOT IN ('spring', 'summer', 'autumn', 'winter')))")
_OUPD = _LISTS + f"""
, chg AS (
    SELECT outfit_id AS change_id, u_id, outfit_id, outfit_name, season, ids,
           CASE WHEN len(ids) >= 2 THEN list_slice(ids, 1, len(ids) - 1) ELSE ids END AS new_ids
    FROM olists
)
, unowned AS (
    SELECT change_id, COUNT(*) AS n FROM (SELECT change_id, u_id, unnest(new_ids) AS item_id FROM chg) x
    WHERE NOT EXISTS (SELECT 1 FROM owned WHERE owned.item_id = x.item_id AND owned.u_id = x.u_id)
    GROUP BY change_id
)
, outc AS (
    SELECT chg.change_id, chg.u_id, chg.outfit_id, chg.new_ids, chg.season,
           CASE WHEN len(chg.new_ids) = 0 THEN 'Select at least one clothing item.'
                WHEN COALESCE(unowned.n, 0) > 0 THEN 'One or more clothing items do not belong to this user.'
                WHEN EXISTS (SELECT 1 FROM w_rec R WHERE R.outfit_id = chg.outfit_id) AND len(chg.ids) >= 2
                     THEN 'Clothing items cannot be changed after an outfit has wear records. Create a new outfit instead.'
                WHEN COALESCE({_SEASON_ERR.format(c='chg.season')}, FALSE)
                     THEN 'Season must be one of: Spring, Summer, Autumn, Winter.'
                ELSE 'updated' END AS outcome
    FROM chg LEFT JOIN unowned ON chg.change_id = unowned.change_id
)
"""
q("outfit_update_lock", _OUPD + "SELECT change_id, u_id, outcome FROM outc")
q("outfit_update_tables", _OUPD + """
, upd AS (SELECT * FROM outc WHERE outcome = 'updated')
""" + _counts(
    {"w_inc": "outfit_id NOT IN (SELECT outfit_id FROM upd)",
     # re-saving cleans the image list, which drops blank image rows
     "w_oimg": "NOT (image_url = '' AND outfit_id IN (SELECT outfit_id FROM upd))"},
    {"w_inc": "SELECT COALESCE(SUM(len(new_ids)), 0) FROM upd"},
    rejects="SELECT COUNT(*) FROM outc WHERE outcome <> 'updated'",
))

_AS_OF = "2026-01-01 00:00:00"
_WEARS = _LISTS + f"""
, asked AS (
    SELECT (outfit_id * 100000 + datediff('day', DATE '1970-01-01', CAST(left(datetime, 10) AS DATE))) * 4 AS change_id, outfit_id,
           weather = 'N' AND mood = 'F' AS blank,
           CASE weather WHEN 'N' THEN datetime WHEN 'A' THEN left(datetime, 10) ELSE '{_AS_OF}' END AS dt,
           weather = 'A' AND rating IS NULL AS bad_rating
    FROM w_rec JOIN w_outfit USING (outfit_id)
)
, sound AS (SELECT *, min(change_id) OVER (PARTITION BY outfit_id, dt) AS winner FROM asked WHERE NOT blank AND NOT bad_rating AND outfit_id <> 0)
, taken AS (SELECT change_id FROM sound LEFT JOIN w_rec ON w_rec.outfit_id = sound.outfit_id AND w_rec.datetime = dt WHERE change_id <> winner OR w_rec.datetime IS NOT NULL)
, newo AS (
    SELECT outfit_id * 100000 * 4 + 2 AS change_id, u_id, ids, occasion, image_url, note FROM olists
)
, foreign_ids AS (
    SELECT DISTINCT change_id FROM (SELECT change_id, u_id, unnest(ids) AS item_id FROM newo) ANTI JOIN owned USING (item_id, u_id)
)
, new_outc AS (
    SELECT newo.*,
           CASE WHEN len(ids) = 0 THEN 'Select at least one clothing item for the outfit.'
                WHEN change_id IN (SELECT change_id FROM foreign_ids) THEN 'One or more clothing items do not belong to this user.'
                WHEN note = '1-URGENT' THEN 'Rating must be between 1 and 5.'
                WHEN note = '5-LOW' THEN 'Season must be one of: Spring, Summer, Autumn, Winter.'
                ELSE 'recorded' END AS outcome
    FROM newo
)
, new_ids AS (
    SELECT change_id, (SELECT max(outfit_id) FROM w_outfit) + row_number() OVER (ORDER BY change_id) AS outfit_id
    FROM new_outc WHERE outcome = 'recorded'
)
, outc AS (
    -- outfit id 0 is no outfit: such a change asks for a new one and names no items
    SELECT change_id, CASE WHEN outcome = 'recorded' THEN outfit_id END AS outfit_id, outcome FROM (
        SELECT change_id, outfit_id,
               CASE WHEN blank THEN 'Invalid outfit.'
                    WHEN outfit_id = 0 THEN 'Select at least one clothing item for the outfit.'
                    WHEN bad_rating THEN 'Rating must be between 1 and 5.'
                    WHEN change_id IN (SELECT change_id FROM taken) THEN 'This outfit already has a record for that date.'
                    ELSE 'recorded' END AS outcome
        FROM asked)
    UNION ALL
    SELECT change_id, new_ids.outfit_id, outcome FROM new_outc LEFT JOIN new_ids USING (change_id)
)
"""
q("record_wears", _WEARS + "SELECT change_id, outfit_id, outcome FROM outc")
q("record_wears_tables", _WEARS + """
, made AS (SELECT * FROM new_outc WHERE outcome = 'recorded')
""" + _counts(
    {},
    {
        "w_outfit": "SELECT count(*) FROM made",
        "w_season": "SELECT count(*) FROM made",
        "w_occ": f"SELECT COALESCE(sum(len(list_distinct({_VALUES.format(c='occasion')}))), 0) FROM made",
        "w_oimg": f"SELECT COALESCE(sum(len(list_distinct({_VALUES.format(c='image_url')}))), 0) FROM made",
        "w_inc": "SELECT COALESCE(sum(len(ids)), 0) FROM made",
        "w_rec": "SELECT count(*) FROM outc WHERE outcome = 'recorded'",
    },
    rejects="SELECT count(*) FROM outc WHERE outcome <> 'recorded'",
))


# Change sets with their values: the outcomes, then the tables' rows afterwards.
def _row(*columns: str) -> str:
    return " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '~')" for c in columns)


def _values(outcomes: str, **relations: str) -> str:
    """``outcomes`` and each relation select (k, v)."""
    parts = [f"SELECT 'outcome' AS relation, k, v FROM ({outcomes}) AS o(k, v)"]
    parts += [f"SELECT '{name}', k, v FROM ({sql}) AS {name}_now(k, v)" for name, sql in relations.items()]
    return "\nUNION ALL\n".join(parts)


def _kept(key: str, *columns: str, table: str, where: str = "TRUE") -> str:
    return f"SELECT {key}, {_row(*columns)} FROM {table} WHERE {where}"


_ITEM_ROW = ("c_id", "item_name", "size", "last_worn")
_CHILD = (("w_tag", "tag"), ("w_cat", "category"), ("w_color", "color"), ("w_img", "image_url"))

q("add_users", """
, named AS (
    SELECT outfit_id AS k, u_id, CASE note WHEN '5-LOW' THEN '' WHEN '1-URGENT' THEN username WHEN '2-HIGH' THEN note ELSE outfit_name END AS name
    FROM w_outfit JOIN w_user USING (u_id)
)
, judged AS (
    SELECT *, CASE WHEN name = '' THEN 'Username and password are required.'
                   WHEN name IN (SELECT username FROM w_user) OR k <> min(k) OVER (PARTITION BY name) THEN 'Username already exists.' ELSE 'added' END AS v
    FROM named
)
, fresh AS (
    SELECT name, u_id, (SELECT max(u_id) FROM w_user) + row_number() OVER (ORDER BY k) AS id, (SELECT max(c_id) FROM w_closet) + row_number() OVER (ORDER BY k) AS c_id
    FROM judged WHERE v = 'added'
)
""" + _values(
    "SELECT k, v FROM judged",
    w_user=_kept("u_id", "username", "gender", "role", table="w_user") + f" UNION ALL SELECT id, {_row('name', 'u_id')} || '|user' FROM fresh",
    w_closet=_kept("c_id", "c_name", "u_id", table="w_closet") + " UNION ALL SELECT c_id, name || chr(39) || 's Closet|' || id FROM fresh",
))
q("add_closets", """
, judged AS (
    SELECT outfit_id AS k, outfit_name, u_id,
           CASE note WHEN '1-URGENT' THEN 'User not found.' WHEN '5-LOW' THEN 'Wardrobe name is required.' ELSE 'added' END AS v
    FROM w_outfit
)
, fresh AS (SELECT (SELECT max(c_id) FROM w_closet) + row_number() OVER (ORDER BY k) AS id, outfit_name, u_id FROM judged WHERE v = 'added')
""" + _values(
    "SELECT k, v FROM judged",
    w_closet=_kept("c_id", "c_name", "u_id", table="w_closet") + f" UNION ALL {_kept('id', 'outfit_name', 'u_id', table='fresh')}",
))
_BY_ITEM = """
, possessed AS (SELECT item_id, c_id, u_id, item_name, size, last_worn, CAST(size AS INTEGER) % 2 = 1 AS odd, COALESCE(last_worn, '') = '' AS never FROM w_item JOIN w_closet USING (c_id))
"""
q("rename_closets", _BY_ITEM + """
, judged AS (
    SELECT item_id AS k, c_id, trim(item_name) AS name, CASE WHEN odd THEN 'Wardrobe not found.' WHEN never THEN 'Wardrobe name is required.' ELSE 'renamed' END AS v FROM possessed
)
, names AS (SELECT c_id, arg_max(name, k) AS name FROM judged WHERE v = 'renamed' GROUP BY c_id)
""" + _values("SELECT k, v FROM judged", w_closet=f"SELECT c_id, {_row('COALESCE(name, c_name)', 'u_id')} FROM w_closet LEFT JOIN names USING (c_id)"))
_FREED = "item_id IN (SELECT item_id FROM w_item JOIN w_closet USING (c_id) WHERE c_name >= 'N')"
q("delete_closets", f"""
, refs AS (SELECT c_id, count(DISTINCT outfit_id) AS n FROM w_item JOIN w_inc USING (item_id) WHERE NOT ({_FREED}) GROUP BY c_id)
, stays AS (SELECT c_id, n FROM refs)
""" + _values(
    """
    SELECT c_id * 2 + turn, CASE WHEN n > 0 THEN 'This wardrobe contains items used by ' || n || ' outfit(s). Update or delete those outfits first.'
                                 WHEN turn = 0 THEN 'deleted' ELSE 'Wardrobe not found.' END
    FROM w_closet LEFT JOIN stays USING (c_id), (VALUES (0), (1)) turns(turn)
    """,
    w_closet=_kept("c_id", "c_name", table="w_closet", where="c_id IN (SELECT c_id FROM stays)"),
    w_item=_kept("item_id", *_ITEM_ROW, table="w_item", where="c_id IN (SELECT c_id FROM stays)"),
    **{t: _kept("item_id", c, table=t, where="item_id IN (SELECT item_id FROM w_item WHERE c_id IN (SELECT c_id FROM stays))") for t, c in _CHILD},
))
q("add_items", _BY_ITEM + """
, judged AS (
    SELECT *, CASE WHEN never THEN 'Item name is required.' WHEN odd THEN 'Wardrobe not found.' ELSE 'added' END AS v FROM possessed
)
, fresh AS (SELECT item_id, (SELECT max(item_id) FROM w_item) + row_number() OVER (ORDER BY item_id) AS id, c_id, item_name, size, last_worn FROM judged WHERE v = 'added')
""" + _values(
    "SELECT item_id, v FROM judged",
    w_item=_kept("item_id", *_ITEM_ROW, table="w_item") + f" UNION ALL {_kept('id', *_ITEM_ROW, table='fresh')}",
    **{t: _kept("item_id", c, table=t) + f" UNION ALL SELECT id, {c} FROM {t} JOIN fresh USING (item_id)" for t, c in _CHILD},
))
_ITEM_CHANGES = _BY_ITEM + "\n"
_UPDATE_OUTCOMES = "SELECT item_id * 2, 'updated' FROM possessed UNION ALL SELECT item_id * 2 + 1, CASE WHEN odd THEN 'Item not found.' ELSE 'updated' END FROM possessed"
_NEW_TAGS = "SELECT item_id, unnest(['new', 'hot']) FROM possessed WHERE NOT odd"
q("update_items_merge", _ITEM_CHANGES + _values(
    _UPDATE_OUTCOMES,
    w_item=f"""SELECT item_id, {_row('c_id', 'item_name', "'X' || size", "CASE WHEN odd THEN COALESCE(last_worn, '') ELSE '2026-02-02' END")} FROM possessed""",
    w_tag=f"SELECT item_id, tag FROM w_tag JOIN possessed USING (item_id) WHERE odd UNION ALL {_NEW_TAGS}",
    w_cat=_kept("item_id", "category", table="w_cat"),
    w_color="SELECT item_id, 'Black' FROM possessed",
    w_img=_kept("item_id", "image_url", table="w_img"),
))
q("update_items_replace", _ITEM_CHANGES + _values(
    _UPDATE_OUTCOMES,
    w_item="SELECT item_id, CASE WHEN odd THEN c_id || '||X' || size || '|' ELSE c_id || '|||2026-02-02' END FROM possessed",
    w_tag=_NEW_TAGS,
    w_cat="SELECT item_id, category FROM w_cat WHERE FALSE",
    w_color="SELECT item_id, 'Black' FROM possessed WHERE odd",
    w_img="SELECT item_id, image_url FROM w_img WHERE FALSE",
))
q("add_outfits", _LISTS + f"""
, mine AS (SELECT outfit_id, list(item_id ORDER BY item_id) AS own FROM w_inc JOIN w_outfit USING (outfit_id) SEMI JOIN owned USING (item_id, u_id) GROUP BY outfit_id)
, judged AS (
    SELECT olists.*, own, CASE WHEN note = '5-LOW' THEN 'Outfit name is required.' WHEN own IS NULL THEN 'Select at least one clothing item.'
                               WHEN outfit_id IN (SELECT outfit_id FROM w_season WHERE season = 'Monsoon') THEN 'Season must be one of: Spring, Summer, Autumn, Winter.'
                               ELSE 'added' END AS v
    FROM olists LEFT JOIN mine USING (outfit_id)
)
, fresh AS (SELECT *, (SELECT max(outfit_id) FROM w_outfit) + row_number() OVER (ORDER BY outfit_id) AS id FROM judged WHERE v = 'added')
""" + _values(
    "SELECT outfit_id, v FROM judged",
    w_outfit=_kept("outfit_id", "u_id", "outfit_name", "note", "created_date", table="w_outfit")
    + f" UNION ALL SELECT id, {_row('u_id', 'outfit_name', 'note')} || '|2026-01-01' FROM fresh",
    **{t: _kept("outfit_id", c, table=t) + f" UNION ALL SELECT id, {c} FROM {t} JOIN (SELECT outfit_id, id FROM fresh) USING (outfit_id) WHERE {c} <> ''"
       for t, c in (("w_season", "season"), ("w_occ", "occasion"), ("w_oimg", "image_url"))},
    w_inc="SELECT outfit_id, CAST(item_id AS VARCHAR) FROM w_inc UNION ALL SELECT id, CAST(unnest(own) AS VARCHAR) FROM fresh",
))
_RECORDS = """
, judged AS (
    SELECT outfit_id * 100000 + datediff('day', DATE '1970-01-01', CAST(left(datetime, 10) AS DATE)) AS k, w_rec.*,
           CASE WHEN weather = 'N' THEN 'Outfit not found.' WHEN {rating} THEN 'Rating must be between 1 and 5.'
                WHEN mood = 'F' THEN 'Record not found.' ELSE '{done}' END AS v
    FROM w_rec JOIN (SELECT outfit_id FROM w_outfit) USING (outfit_id)
)
"""
q("update_records", _RECORDS.format(rating="rating IS NULL", done="updated") + _values(
    "SELECT k, v FROM judged",
    w_rec=f"SELECT outfit_id, {_row('datetime', 'rating', 'weather', 'note', 'mood')} FROM judged WHERE v <> 'updated' "
          "UNION ALL SELECT outfit_id, datetime || '|' || (6 - rating) || '|Windy|was ' || weather || '|' FROM judged WHERE v = 'updated'",
))
q("delete_records", _RECORDS.format(rating="FALSE", done="deleted") + _values(
    "SELECT k, v FROM judged", w_rec="SELECT outfit_id, datetime FROM judged WHERE v <> 'deleted'"))
q("insert_or_ignore", "SELECT item_id, color AS tag FROM w_color ANTI JOIN (SELECT item_id, tag AS color FROM w_tag) USING (item_id, color)")
_GONE = """
, gone AS (SELECT u_id FROM w_user WHERE gender IS NULL AND role = 'user')
, left_closets AS (SELECT c_id FROM w_closet ANTI JOIN gone USING (u_id))
, left_items AS (SELECT item_id FROM w_item SEMI JOIN left_closets USING (c_id))
, left_outfits AS (SELECT outfit_id FROM w_outfit ANTI JOIN gone USING (u_id))
"""
_STILL = {"w_user": "u_id NOT IN (SELECT u_id FROM gone)", "w_closet": "c_id IN (SELECT c_id FROM left_closets)"}
_STILL |= {t: "item_id IN (SELECT item_id FROM left_items)" for t in ("w_item", "w_tag", "w_cat", "w_color", "w_img")}
_STILL |= {t: "outfit_id IN (SELECT outfit_id FROM left_outfits)" for t in ("w_outfit", "w_oimg", "w_season", "w_occ", "w_inc", "w_rec")}
_STILL["w_inc"] += " AND item_id IN (SELECT item_id FROM left_items)"
q("delete_users", _GONE + _counts(_STILL).replace("\nUNION ALL\nSELECT 'rejects', CAST((SELECT 0) AS BIGINT)", ""))

q("clean_lists", _LISTS + """
, raw AS (
    SELECT R.outfit_id, R.datetime,
           CASE WHEN R.weather = 'A' THEN '0'
                WHEN R.weather = 'R' THEN ' ' || CAST(R.rating AS VARCHAR) || ' '
                WHEN R.mood = 'O' THEN 'x'
                ELSE CAST(R.rating AS VARCHAR) END AS rating_raw,
           upper(COALESCE(L.season, '')) || ', ,' AS season_raw,
           ' ' || array_to_string(L.ids, ',') || ', x,' || COALESCE(CAST(L.ids[1] AS VARCHAR), '') AS ids_raw
    FROM w_rec R JOIN olists L ON R.outfit_id = L.outfit_id
)
, parsed AS (
    SELECT *, trim(rating_raw) AS rt,
           list_transform(list_filter(list_transform(string_split(season_raw, ','), lambda x: trim(x)), lambda x: x <> ''),
               lambda x: CASE lower(x) WHEN 'spring' THEN 'Spring' WHEN 'summer' THEN 'Summer'
                                       WHEN 'autumn' THEN 'Autumn' WHEN 'winter' THEN 'Winter' END) AS sl,
           list_filter(list_transform(string_split(ids_raw, ','), lambda x: TRY_CAST(trim(x) AS BIGINT)),
               lambda x: x IS NOT NULL) AS il
    FROM raw
)
SELECT outfit_id, datetime,
       CASE WHEN rating_raw IS NULL OR rating_raw = '' OR rating_raw = '0' THEN NULL
            WHEN TRY_CAST(rt AS INTEGER) BETWEEN 1 AND 5 THEN TRY_CAST(rt AS INTEGER) END AS rating,
       NOT (rating_raw IS NULL OR rating_raw = '' OR rating_raw = '0')
           AND COALESCE(TRY_CAST(rt AS INTEGER) NOT BETWEEN 1 AND 5, TRUE) AS rating_error,
       CASE WHEN NOT list_bool_or(list_transform(sl, lambda x: x IS NULL)) OR len(sl) = 0
            THEN array_to_string(list_filter(sl, lambda x, i: list_position(sl, x) = i), ',') END AS seasons,
       COALESCE(list_bool_or(list_transform(sl, lambda x: x IS NULL)), FALSE) AS season_error,
       array_to_string(list_filter(il, lambda x, i: list_position(il, x) = i), ',') AS item_ids
FROM parsed
""")

# The stream applies the same changes in two micro-batches; the final counts equal the one-batch job's.
q("stream_wear_ingest", _Q["record_wears_tables"])

# Q20 with its arrays as text.
q("outfit_detail_nested", _DETAIL + _CATALOG + f"""
, texts AS (
    SELECT outfit_id, string_agg({_row('item_name', 'item_id', 'c_name', 'tag', 'category', 'color', 'image_url')}, ';' ORDER BY item_name, item_id) AS items
    FROM w_inc JOIN catalog USING (item_id) GROUP BY outfit_id
)
SELECT {D_COLS}, COALESCE(array_to_string(ids, ','), '') AS item_ids, items FROM detail LEFT JOIN texts USING (outfit_id)
""")

# Q20's nested item rows, flattened, equal Q18's rows.
q("outfit_detail_nested_items", _Q["outfit_items"])


# ------------------------------------------------------ states kept up by deltas
# The records and links that are there after the wears (M11), the deleted records
# (M12) and the deleted outfits (M10), and the counts over them.
_AFTER_WEARS = _WEARS + """
, first_item AS (SELECT outfit_id, MIN(item_id) AS item_id FROM w_inc GROUP BY outfit_id)
, gone AS (
    SELECT outfit_id FROM w_outfit LEFT JOIN first_item USING (outfit_id) LEFT JOIN owned ON owned.item_id = first_item.item_id
    WHERE owned.u_id IS NULL OR owned.u_id = w_outfit.u_id
)
, recs AS (
    SELECT * FROM (
        SELECT outfit_id, datetime FROM w_rec WHERE weather = 'N' OR mood = 'F'
        UNION ALL SELECT outfit_id, dt FROM asked SEMI JOIN (SELECT change_id FROM outc WHERE outcome = 'recorded') USING (change_id)
        UNION ALL SELECT new_ids.outfit_id, created_date || ' 12:00:00'
        FROM new_ids JOIN w_outfit ON new_ids.change_id = w_outfit.outfit_id * 400000 + 2
    ) ANTI JOIN gone USING (outfit_id)
)
, inc AS (
    SELECT * FROM (SELECT outfit_id, item_id FROM w_inc UNION ALL SELECT outfit_id, unnest(ids) FROM new_ids JOIN new_outc USING (change_id))
    ANTI JOIN gone USING (outfit_id)
)
, by_item AS (SELECT item_id, count(*) AS worn, max(datetime) AS latest FROM inc JOIN recs USING (outfit_id) GROUP BY item_id)
"""
q("wear_counts_by_deltas", _AFTER_WEARS + """
SELECT 'item' AS kind, item_id AS id, worn, latest FROM by_item
UNION ALL SELECT 'outfit', outfit_id, count(*), max(datetime) FROM recs GROUP BY outfit_id
""")
q("most_worn_by_deltas", _AFTER_WEARS + f"""
, days AS (
    SELECT item_id, max(left(dt, 10)) AS day FROM (
        SELECT item_id, dt FROM asked SEMI JOIN (SELECT change_id FROM outc WHERE outcome = 'recorded') USING (change_id) JOIN w_inc USING (outfit_id)
        UNION ALL SELECT unnest(ids), created_date || ' 12:00:00' FROM new_ids JOIN new_outc USING (change_id) JOIN w_outfit ON change_id = w_outfit.outfit_id * 400000 + 2
    ) GROUP BY item_id
)
, usage AS (
    SELECT owner.u_id, item.item_id, item.item_name, COALESCE(worn, 0) AS wear_count,
           CASE WHEN day IS NOT NULL AND (last_worn IS NULL OR last_worn < day) THEN day ELSE last_worn END AS last_worn,
           {_text('w_cat', 'category', 'item_id', 'item')},
           {_text('w_color', 'color', 'item_id', 'item')}
    FROM w_item AS item JOIN w_closet AS owner USING (c_id) LEFT JOIN by_item USING (item_id) LEFT JOIN days USING (item_id)
)
SELECT u_id, item_id, item_name, category, color, last_worn, wear_count FROM usage QUALIFY {_ranked('-')} <= 5
""")
_FACETED = """
SELECT u_id, facet, value, count(*) AS n FROM valued GROUP BY ALL
"""
q("facet_counts", f"""
, valued AS (
    SELECT u_id, 'tags' AS facet, tag AS value FROM w_tag JOIN w_item USING (item_id) JOIN w_closet USING (c_id)
    UNION ALL SELECT u_id, 'colors', color FROM w_color JOIN w_item USING (item_id) JOIN w_closet USING (c_id)
    UNION ALL SELECT u_id, 'categories', category FROM w_cat JOIN w_item USING (item_id) JOIN w_closet USING (c_id)
    UNION ALL SELECT u_id, 'primary', min(category) FROM w_cat JOIN w_item USING (item_id) JOIN w_closet USING (c_id) GROUP BY item_id, u_id
    UNION ALL SELECT u_id, 'seasons', season FROM w_season JOIN w_outfit USING (outfit_id)
    UNION ALL SELECT u_id, 'occasions', occasion FROM w_occ JOIN w_outfit USING (outfit_id)
)
""" + _FACETED)
q("facet_counts_by_deltas", _BY_ITEM + f"""
, stay AS (
    SELECT item_id, u_id, odd FROM possessed
    SEMI JOIN (SELECT item_id, u_id FROM w_inc JOIN w_outfit USING (outfit_id)) AS used USING (item_id, u_id)
)
, copies AS (SELECT item_id, u_id FROM possessed WHERE NOT never AND NOT odd)
, valued AS (
    SELECT u_id, 'tags' AS facet, tag AS value FROM w_tag JOIN copies USING (item_id)
    UNION ALL SELECT u_id, 'colors', color FROM w_color JOIN copies USING (item_id)
    UNION ALL SELECT u_id, 'categories', category FROM w_cat JOIN copies USING (item_id)
    UNION ALL SELECT u_id, 'primary', min(category) FROM w_cat JOIN copies USING (item_id) GROUP BY item_id, u_id
    UNION ALL SELECT u_id, 'tags', unnest(['new', 'hot']) FROM stay WHERE NOT odd
    UNION ALL SELECT u_id, 'colors', 'Black' FROM stay WHERE odd
)
""" + _FACETED)
q("report_rows_ranges", _Q["report_rows"])
q("season_facet_ranges", _Q["season_facet"])
q("item_places", """
SELECT u_id, item_id, item_name, row_number() OVER (PARTITION BY u_id ORDER BY item_name, item_id) AS place FROM w_item JOIN w_closet USING (c_id)
""")


# ------------------------------------------------------ alternate names, files
q("add_users_alternate", _Q["add_users"])
q("rename_closets_alternate", _Q["rename_closets"])
q("item_catalog_json", _Q["item_catalog"])
q("change_quarantine", _LISTS + """
, asked AS (
    SELECT (outfit_id * 100000 + datediff('day', DATE '1970-01-01', CAST(left(datetime, 10) AS DATE))) * 4 AS id FROM w_rec JOIN w_outfit USING (outfit_id)
    UNION ALL SELECT outfit_id * 400000 + 2 FROM w_outfit
)
SELECT id AS change_id, CASE WHEN id % 40 = 4 THEN 'The line could not be parsed.' WHEN id % 40 = 8 THEN 'Unknown field: colour'
                             WHEN id % 40 = 12 THEN 'A field has the wrong type.' ELSE 'good' END AS state
FROM asked
""")


# ------------------------------------------------------ faults
_FAULTS = """
, x_tag AS (
    SELECT item_id, CASE WHEN item_id % 13 <> 5 THEN tag END AS tag FROM (SELECT * FROM w_tag UNION ALL SELECT * FROM w_tag WHERE item_id % 11 = 4)
)
, x_item AS (SELECT * REPLACE (CASE WHEN item_id % 17 = 6 THEN -5 ELSE c_id END AS c_id) FROM w_item)
, x_user AS (SELECT * REPLACE (CASE WHEN u_id = 2 THEN 'guest' ELSE role END AS role) FROM w_user)
, x_outfit AS (SELECT * FROM w_outfit UNION ALL SELECT * REPLACE ('other' AS note) FROM w_outfit WHERE outfit_id % 23 = 7)
, x_inc AS (SELECT outfit_id, CASE WHEN outfit_id % 29 = 8 THEN -item_id ELSE item_id END AS item_id FROM w_inc)
, x_rec AS (SELECT * REPLACE (CASE WHEN outfit_id % 19 = 3 THEN 6 ELSE rating END AS rating) FROM w_rec)
, x_img AS (
    SELECT item_id, CASE item_id % 7 WHEN 2 THEN image_url || '.svg' WHEN 3 THEN 'noname' ELSE image_url END AS image_url FROM w_img
)
"""


def _faulty(sql: str) -> str:
    """``sql`` over the tables with faults, its results still naming the tables."""
    import re

    for name in ("tag", "item", "user", "outfit", "inc", "rec", "img"):
        sql = re.sub(rf"(FROM|JOIN) w_{name}\b", rf"\1 x_{name}", sql)
    return _FAULTS + sql


for _name in ("audit_pk", "audit_not_null", "audit_check", "audit_fk", "audit_fd"):
    q(f"{_name}_faults", _faulty(_Q[_name]))
_IMAGES = _all_of(
    f"SELECT '{t}' AS table_name, {k} AS id, image_url FROM {t} WHERE image_url <> '' AND NOT regexp_matches(lower(image_url), '\\.(png|jpg|jpeg|gif|webp)$')"
    for t, k in (("w_img", "item_id"), ("w_oimg", "outfit_id")))
q("audit_images", _IMAGES)
q("audit_images_faults", _faulty(_IMAGES))


# ------------------------------------------------------ whole tables by digest
_COLUMNS = {
    "w_user": "u_id username gender role", "w_closet": "c_id c_name u_id", "w_item": "item_id c_id item_name size last_worn",
    "w_tag": "item_id tag", "w_cat": "item_id category", "w_color": "item_id color", "w_img": "item_id image_url",
    "w_outfit": "outfit_id u_id outfit_name note created_date", "w_oimg": "outfit_id image_url", "w_season": "outfit_id season",
    "w_occ": "outfit_id occasion", "w_inc": "outfit_id item_id", "w_rec": "outfit_id datetime rating weather note mood",
}


def _all_digests(now: dict[str, str]) -> str:
    """Row count and digest of every table; ``now`` gives a table's rows where they
    are not the stored ones."""
    parts = []
    for name, columns in _COLUMNS.items():
        rows = now.get(name, f"SELECT * FROM {name}")
        half = "CAST(COALESCE(sum(CAST('0x' || h[{0}:{1}] AS BIGINT)), 0) AS VARCHAR)"
        parts.append(
            f"SELECT '{name}' AS table_name, count(*) AS n_rows, {half.format(1, 15)} || '-' || {half.format(16, 30)} AS digest "
            f"FROM (SELECT md5({_row(*columns.split())}) AS h FROM ({rows}) AS rows_now({', '.join(columns.split())}))"
        )
    return "\nUNION ALL\n".join(parts)


def _where(filters: dict[str, str]) -> dict[str, str]:
    return {n: f"SELECT * FROM {n} WHERE {f}" for n, f in filters.items()}


q("cascade_delete_digests", _OREQ + _all_digests(_where({n: _ODEL for n in ("w_outfit", "w_oimg", "w_season", "w_occ", "w_inc", "w_rec")})))
q("delete_items_digests", _IREQ + _all_digests(_where({n: _IDEL for n in ("w_item", "w_tag", "w_cat", "w_color", "w_img", "w_inc")})))
q("delete_users_digests", _GONE + _all_digests(_where(_STILL)))
q("outfit_update_digests", _OUPD + """
, upd AS (SELECT * FROM outc WHERE outcome = 'updated')
""" + _all_digests({
    "w_outfit": "SELECT * REPLACE (CASE WHEN outfit_id IN (SELECT outfit_id FROM upd) THEN COALESCE(note, '') ELSE note END AS note) FROM w_outfit",
    "w_oimg": "SELECT * FROM w_oimg WHERE NOT (image_url = '' AND outfit_id IN (SELECT outfit_id FROM upd))",
    "w_inc": "SELECT outfit_id, item_id FROM w_inc WHERE outfit_id NOT IN (SELECT outfit_id FROM upd) UNION ALL SELECT outfit_id, unnest(new_ids) FROM upd",
}))
q("record_wears_digests", _AFTER_WEARS + f"""
, made AS (SELECT new_outc.*, new_ids.outfit_id AS id, o.outfit_name, o.created_date FROM new_outc JOIN new_ids USING (change_id) JOIN w_outfit AS o ON change_id = o.outfit_id * 400000 + 2)
, again AS (
    SELECT asked.outfit_id, dt, w_rec.rating, w_rec.weather, w_rec.mood
    FROM (SELECT *, change_id // 4 % 100000 AS day FROM asked) AS asked
    JOIN w_rec ON w_rec.outfit_id = asked.outfit_id AND datediff('day', DATE '1970-01-01', CAST(left(w_rec.datetime, 10) AS DATE)) = day
    SEMI JOIN (SELECT change_id FROM outc WHERE outcome = 'recorded') AS kept USING (change_id)
)
, days AS (
    SELECT item_id, max(left(dt, 10)) AS day FROM (
        SELECT item_id, dt FROM again JOIN w_inc USING (outfit_id) UNION ALL SELECT unnest(ids), created_date FROM made
    ) GROUP BY item_id
)
""" + _all_digests({
    "w_item": "SELECT item_id, c_id, item_name, size, CASE WHEN day IS NOT NULL AND (last_worn IS NULL OR last_worn < day) THEN day ELSE last_worn END "
              "FROM w_item LEFT JOIN days USING (item_id)",
    "w_outfit": "SELECT * FROM w_outfit UNION ALL SELECT id, u_id, 'Worn ' || outfit_name, '', created_date FROM made",
    "w_season": "SELECT * FROM w_season UNION ALL SELECT id, 'Summer' FROM made",
    "w_occ": f"SELECT * FROM w_occ UNION ALL SELECT id, unnest(list_distinct({_VALUES.format(c='occasion')})) FROM made",
    "w_oimg": f"SELECT * FROM w_oimg UNION ALL SELECT id, unnest(list_distinct({_VALUES.format(c='image_url')})) FROM made",
    "w_inc": "SELECT * FROM w_inc UNION ALL SELECT id, unnest(ids) FROM made",
    "w_rec": "SELECT * FROM w_rec UNION ALL SELECT outfit_id, dt, rating, weather, '', mood FROM again "
             "UNION ALL SELECT id, created_date || ' 12:00:00', 3, 'Sunny', '', 'Happy' FROM made",
}))
