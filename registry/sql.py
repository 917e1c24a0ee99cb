"""Shared SQL views of the same roles, and a helper that puts the needed ones before a query."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it uses, directly or through other views, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\bv_[a-z0-9_]+", text)):
            if word in VIEWS and word not in needed:
                needed.add(word)
                visit(VIEWS[word])

    visit(body)
    ordered = [n for n in VIEWS if n in needed]
    if not ordered:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered) + "\n" + body.strip()


SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"


def slug(expr: str) -> str:
    return SLUG.format(expr)


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


view("v_listens", f"""
  SELECT cast(user_id AS VARCHAR) AS user_id, 'The ' || event_type AS artist_name,
         'Song No. ' || json_extract_string(props, '$.k') AS track_name, ts,
         'track_' || substr(sha1({slug("'The ' || event_type")} || '::' || {slug("'Song No. ' || json_extract_string(props, '$.k')")}), 1, 16) AS track_id
  FROM events
""")
view("v_event_plays", "SELECT user_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS track_id, ts FROM events")
view("v_plays", """
  SELECT o_custkey AS user_id, l_partkey AS track_id, l_shipdate AS played_at, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
view("v_interactions", """
  SELECT user_id, track_id, sum(quantity) AS interaction_strength, max(played_at) AS last_timestamp
  FROM v_plays GROUP BY 1, 2
""")
view("v_li", """
  SELECT l_partkey AS track_id, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_quantity) AS q,
         sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1
""")
view("v_tracks", """
  SELECT p_partkey AS track_id, p_name AS track_name, p_brand AS artist_name,
         p_type || ', ' || split_part(p_name, ' ', -1) AS artist_genres,
         p_size / 50.0::DOUBLE AS danceability, coalesce(q, 25.0) / 50.0::DOUBLE AS energy,
         least(coalesce(d, 0.0) * 10.0::DOUBLE, 1.0) AS valence, 60.0::DOUBLE + p_retailprice % 100.0::DOUBLE AS tempo,
         least(coalesce(t, 0.0) * 12.5::DOUBLE, 1.0) AS acousticness, (p_size % 10) / 10.0::DOUBLE AS instrumentalness,
         -p_retailprice / 100.0::DOUBLE AS loudness,
         coalesce(s, 0.0) * 100.0::DOUBLE / (SELECT max(s) FROM v_li) AS popularity,
         coalesce(n, 0) * 1000 AS duration_ms, cast(1950 + p_size AS VARCHAR) || '-01-01' AS album_release_date
  FROM part LEFT JOIN v_li ON track_id = p_partkey
""")
view("v_artists", """
  SELECT 'Brand#' || s_suppkey AS artist_id, s_name AS name,
         n_name || ',  folk  rock, ' || n_name AS genres, s_acctbal AS popularity, s_suppkey * 10 AS followers_total
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
view("v_recent", """
  SELECT user_id, track_id, played_at, pos, p_name AS track_name, p_brand AS artist_name,
         p_type || ', ' || split_part(p_name, ' ', -1) AS artist_genres
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY played_at DESC, track_id) - 1 AS pos FROM v_plays) r
  JOIN part ON p_partkey = track_id WHERE pos < 20
""")
view("v_seeds", """
  SELECT user_id, track_id, seed_pos FROM (
    SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY min(pos), track_id) - 1 AS seed_pos
    FROM v_recent GROUP BY 1, 2) WHERE seed_pos < 8
""")
view("v_curated", """
  SELECT *, popularity / 100.0::DOUBLE AS catalog_popularity, 1.0::DOUBLE - popularity / 100.0::DOUBLE AS catalog_novelty,
         'audio-features' AS ranking_mode FROM v_tracks
""")
