"""SQL of queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations


def vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Exact product codes: the rounds are written out one after the other."""
    nearest = """SELECT v.vec_id, v.k, v.v, min(struct_pack(d := list_sum(list_transform(list_zip(v.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.e)) AS best
        FROM cut v JOIN book{n} b USING (k) GROUP BY v.vec_id, v.k, v.v"""
    steps = [f"""kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS nth
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""cut AS MATERIALIZED (
        SELECT vec_id, nth, k, v[k * (len(v) // {parts}) + 1 : (k + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) AS t(k))""",
             f"book0 AS MATERIALIZED (SELECT k, nth AS e, v AS c FROM cut WHERE nth < {entries})"]
    for n in range(rounds):
        steps += [f"near{n} AS MATERIALIZED ({nearest.format(n=n)})",
                  f"""mean{n} AS (
        SELECT k, e, p, CAST((s - ((s % n + n) % n)) // n AS BIGINT) AS c FROM (
            SELECT k, best.e AS e, p, sum(v[p]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS p FROM near{n}) GROUP BY ALL))""",
                  f"""book{n + 1} AS MATERIALIZED (
        SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN (SELECT k, e, list(c ORDER BY p) AS c FROM mean{n} GROUP BY k, e) m USING (k, e))"""]
    return f"""WITH {", ".join(steps)}, last AS ({nearest.format(n=rounds)}),
        coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY k) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""
