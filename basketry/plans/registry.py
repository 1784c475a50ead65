"""All registered queries and the SQL that must agree with them."""

from basketry.plans import churn, churn_sql, demand, demand_sql, line_sql, lines, segment_sql, segments


def queries():
    return {**lines.QUERIES, **churn.QUERIES, **segments.QUERIES, **demand.QUERIES}


def oracle_sql():
    return {**line_sql.SQL, **churn_sql.SQL, **segment_sql.SQL, **demand_sql.SQL}
