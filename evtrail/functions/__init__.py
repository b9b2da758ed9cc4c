"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from evtrail.functions.dates import (  # noqa: F401
    day_number, days_between_floor, parse_timestamp_multi, parse_yyyymmdd, iso_date_or_raw,
)
from evtrail.functions.text import (  # noqa: F401
    clean_text, null_tokens_to_null, word_tokens, normalize_header,
)
from evtrail.functions.geo import haversine_km  # noqa: F401
from evtrail.functions.prefix import grouped_prefix_sums  # noqa: F401
