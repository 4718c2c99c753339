"""Reusable SQL text for oracles: distribution tails by Simpson's rule, BH adjustment, Welch moments."""


def t_tail(source: str, key: str, out: str = "tails", t: str = "t_stat", df: str = "df", n: int = 2000) -> str:
    """CTE ``out(key..., p)``: two-sided Student tail, integrating cos(theta)^(df-1) numerically."""
    return f"""{out} AS (
  SELECT {key}, 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * h / 3
         * sum((CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
               * pow(greatest(cos(th0 + i * h), 0), {df} - 1)) AS p
  FROM (SELECT {key}, {df}, atan(abs({t}) / sqrt({df})) AS th0,
               least(pi() / 2 - atan(abs({t}) / sqrt({df})), 12 / sqrt({df})) / {n} AS h
        FROM {source} WHERE {t} IS NOT NULL) z, range(0, {n + 1}) s(i)
  GROUP BY {key}, {df}, th0, h)"""


def normal_tail(source: str, key: str, out: str, z: str, n: int = 2000) -> str:
    return f"""{out} AS (
  SELECT {key}, 2 / sqrt(2 * pi()) * (10.0 / {n}) / 3
         * sum((CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
               * exp(-pow(abs({z}) + i * 10.0 / {n}, 2) / 2)) AS p
  FROM (SELECT {key}, {z} FROM {source} WHERE {z} IS NOT NULL) q, range(0, {n + 1}) s(i) GROUP BY {key}, {z})"""


def bh(p: str = "p_value", family: str = "", order_source: str = "") -> str:
    """Two-level BH needs ranks first; use ``bh_ranked`` for the inner select."""
    part = f"PARTITION BY {family} " if family else ""
    return f"least(1.0, min({p} * _m / _r) OVER ({part}ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING))"


def bh_ranks(p: str = "p_value", family: str = "") -> str:
    part = f"PARTITION BY {family} " if family else ""
    return (
        f"count(*) OVER ({part}ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS _r, "
        + (f"count(*) OVER (PARTITION BY {family}) AS _m" if family else "count(*) OVER () AS _m")
    )


def moments(source: str, key: str, features: str, n_a: str, n_b: str, a: str, b: str, value: str, out: str = "mom") -> str:
    """Dense-form moments per feature: squared deviations of stored values plus the zero block."""
    def side(s, level):
        return (
            f"count(*) FILTER (WHERE condition = '{level}') AS k{s}, "
            f"coalesce(sum({value}) FILTER (WHERE condition = '{level}'), 0) / n{s} AS m{s}"
        )
    return f"""{out}_n AS (SELECT CAST(({n_a}) AS DOUBLE) AS na, CAST(({n_b}) AS DOUBLE) AS nb),
{out}_s AS (SELECT f.{key}, na, nb, {side('a', a)}, {side('b', b)}
  FROM {features} f CROSS JOIN {out}_n LEFT JOIN {source} USING ({key}) GROUP BY f.{key}, na, nb),
{out} AS (SELECT s.{key}, na, nb, ma, mb,
   (coalesce(sum(pow({value} - ma, 2)) FILTER (WHERE condition = '{a}'), 0) + (na - ka) * ma * ma) / (na - 1) AS va,
   (coalesce(sum(pow({value} - mb, 2)) FILTER (WHERE condition = '{b}'), 0) + (nb - kb) * mb * mb) / (nb - 1) AS vb
  FROM {out}_s s LEFT JOIN {source} USING ({key}) GROUP BY s.{key}, na, nb, ka, kb, ma, mb)"""


WELCH_T = "CASE WHEN va / na + vb / nb > 0 THEN (ma - mb) / sqrt(va / na + vb / nb) END"
WELCH_DF = (
    "CASE WHEN va / na + vb / nb > 0 THEN pow(va / na + vb / nb, 2) "
    "/ (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) END"
)
