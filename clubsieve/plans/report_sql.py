"""Oracle SQL that several report checks share."""
from __future__ import annotations

from ..functions import fixed_values as fv
from .sql_parts import half_up

_MISSING = " + ".join(f"({f} IS NULL)::int" for f in fv.ENRICHABLE_FIELDS)
WORK_LIST_SQL = f"""
SELECT url_scraped AS url, min(organization_name) AS org_name, min(base_domain) AS base_domain, count(*) AS league_count,
  cast({half_up('sum(quality_score)', 'count(quality_score)', 0)} AS int) AS avg_quality, sum({_MISSING})::bigint AS total_missing,
  cast({half_up(f'sum({_MISSING})', 'count(*)', 0)} AS int) AS avg_missing
FROM listings_x WHERE NOT is_archived GROUP BY url_scraped"""
