"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)"
_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)"
_SQUARE = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def phrase_index(width: int = 10) -> str:
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )

    def run(length: str) -> str:
        """Words of a list from place i on, as one text; words hold no blanks."""
        return f"array_to_string(w[i : i + {length} - 1], ' ')"

    return (
        f"WITH d AS (SELECT doc_id, {words} AS w FROM documents), "
        f"b AS (SELECT item_id, w, least(len(w), {width}) AS size FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0), "
        f"windows AS (SELECT DISTINCT item_id, size, {run('size')} AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)), "
        "sizes AS (SELECT DISTINCT size FROM windows), "
        f"places AS (SELECT doc_id, i, size, {run('size')} AS phrase FROM "
        "(SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= size)), "
        "found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, phrase)), "
        "hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM "
        "(SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id), "
        "items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed "
        "FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id) "
        "SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, "
        "sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated "
        "FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"
    )


def bisector_clusters(k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> str:
    square = _SQUARE.format(a="t.v", b="c.v")
    steps = [
        f"t AS (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE len(embedding) = {dim} AND {_FINITE})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, v FROM t QUALIFY cluster < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS (SELECT vec_id, any_value(v) AS v, arg_min(cluster, d * {k} + cluster) AS cluster, min(d) AS distance "
            f"FROM (SELECT vec_id, t.v, cluster, {square}::BIGINT AS d FROM t CROSS JOIN c{r} AS c) GROUP BY vec_id)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT cluster, list(mean ORDER BY i) AS v FROM (SELECT cluster, i, floor(sum(v[i]) / count(*))::BIGINT AS mean "
                f"FROM a{r} CROSS JOIN (SELECT unnest(range(1, {dim} + 1)) AS i) GROUP BY cluster, i) GROUP BY cluster)"
            )
            steps.append(f"c{r + 1} AS (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN m{r} AS m USING (cluster))")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, cluster::INTEGER AS cluster, distance, "
        "(sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} AS c USING (cluster)"
    )


def ball_codes(parts: int = 16, entries: int = 64, rounds: int = 2, dim: int = 64) -> str:
    width = dim // parts
    square = _SQUARE.format(a="p.v", b="c.v")
    steps = [
        f"t AS MATERIALIZED (SELECT vec_id, label, {_WHOLE} AS v FROM embeddings WHERE {_FINITE})",
        f"p AS MATERIALIZED (SELECT vec_id, part, v[part * {width} + 1 : part * {width} + {width}] AS v "
        f"FROM t CROSS JOIN (SELECT unnest(range({parts})) AS part))",
        f"c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(v) AS v, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS error "
            f"FROM (SELECT vec_id, part, p.v, entry, {square}::BIGINT AS d FROM p JOIN c{r} AS c USING (part)) GROUP BY vec_id, part)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT part, entry, list(mean ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(v[i]) / count(*))::BIGINT AS mean "
                f"FROM a{r} CROSS JOIN (SELECT unnest(range(1, {width} + 1)) AS i) GROUP BY part, entry, i) GROUP BY part, entry)"
            )
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN m{r} AS m USING (part, entry))"
            )
    return (
        f"WITH {', '.join(steps)}, "
        f"f AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a{rounds} GROUP BY vec_id), "
        f"s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}) "
        "SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN t USING (vec_id) CROSS JOIN s"
    )
