"""DuckDB twins of ``jobsift.sources.fixtures`` used by the oracle SQL.

``with_views(sql, "vacancy", ...)`` prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "vacancy": """
  SELECT p_partkey AS vacancy_id,
         CASE WHEN p_partkey % 3 = 0 THEN p_name
              ELSE concat(p_name, ' / ', lower(p_type), ' (', p_brand, ')') END AS name_raw,
         p_name AS name,
         CASE WHEN p_partkey % 11 = 0 THEN NULL
              ELSE [p_name, lower(p_type), concat('size', CAST(p_size AS VARCHAR))] END AS keySkills,
         CASE WHEN p_partkey % 11 = 0 THEN NULL
              ELSE concat(p_name, ' ', lower(p_type), ' size', CAST(p_size AS VARCHAR)) END AS keySkills_str,
         concat('c_', CAST(p_partkey % 37 AS VARCHAR)) AS company_id,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS compensation_from,
         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice * 1.5 END AS compensation_to,
         CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 'USD' ELSE 'RUR' END
              AS compensation_currencyCode,
         p_brand AS area_id,
         CASE p_type WHEN 'ECONOMY' THEN 'part' WHEN 'SMALL' THEN 'project' WHEN 'MEDIUM' THEN 'probation'
              WHEN 'PROMO' THEN 'volunteer' ELSE 'full' END AS employment,
         CASE p_size % 5 WHEN 0 THEN 'fullDay' WHEN 1 THEN 'shift' WHEN 2 THEN 'remote'
              WHEN 3 THEN 'flexible' ELSE 'flyInFlyOut' END AS workSchedule,
         CASE WHEN p_size <= 12 THEN 'noExperience' WHEN p_size <= 25 THEN 'between1And3'
              WHEN p_size <= 37 THEN 'between3And6' ELSE 'moreThan6' END AS workExperience
  FROM part""",
    "interaction": """
  SELECT user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS vacancy_id,
         CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS action_type,
         ts AS action_dt,
         event_id,
         concat(CAST(user_id AS VARCHAR), '_', CAST(CAST(ts AS DATE) AS VARCHAR)) AS session_id,
         ts < TIMESTAMP '2024-01-16 00:00:00' AS is_train
  FROM events WHERE event_type IN ('purchase', 'view', 'click')""",
    "request": """
  SELECT c_custkey AS user_id,
         900.0 + abs(c_acctbal) / 100 AS compensation_from,
         concat('Brand#', CAST(c_nationkey + 1 AS VARCHAR)) AS area_id,
         c_custkey % 9 AS experience_years,
         v.name AS title,
         lower(v.keySkills_str) AS skills
  FROM customer JOIN vacancy v ON v.vacancy_id = c_custkey""",
    "descriptions": """
  SELECT doc_id AS vacancy_id, text AS description FROM documents""",
    "vectors": """
  SELECT vec_id AS vacancy_id, embedding AS vec, label FROM embeddings""",
}

# views that other views read
_DEPENDS = {"request": ["vacancy"]}


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named fixture views (dependencies first),
    followed by ``extra`` CTEs in the given order."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in order]
    for n, body in (extra or {}).items():
        parts.append(f"{n} AS ({body}\n)")
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
