"""Activity records of the users of the events table."""
from harborline.plans.registry import query
from harborline.sources.tables import table
from harborline.streaming.events import PRECEDENCE
from harborline.streaming.records import BAD, records

_RANK = "coalesce(list_position([" + ", ".join(f"'{p}'" for p in PRECEDENCE) + "], event_type), 0)"


@query(
    "user_records",
    f"""WITH e AS (SELECT user_id, event_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS begins FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS record FROM e),
        b AS (SELECT *, sum(CASE WHEN event_type = '{BAD}' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, record ORDER BY ts DESC, event_id DESC) AS bad_since FROM r)
        SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, arg_max(event_type, ({_RANK}, ts, event_id)) AS status, count(*) FILTER (WHERE bad_since = 0) AS streak FROM b GROUP BY user_id, record""",
)
def user_records(spark, sf_dir):
    """First and last seen, count, status and streak of each run of a user's events without a pause of over six hours."""
    return records(table(spark, sf_dir, "events"))
