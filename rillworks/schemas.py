"""Row types of the data model."""

from __future__ import annotations





FEED = "feed_idx INT, feed_url STRING"
ARTICLE = "feed_idx INT, entry_idx INT, link STRING, source STRING, title STRING, summary STRING"
HEADER = "STRUCT<message_id: STRING, timestamp: STRING, type: STRING>"
URL_PAYLOAD = "STRUCT<url: STRING, source_rss: STRING>"
MESSAGE = f"header {HEADER}, data {URL_PAYLOAD}"
LOG = "stream STRING, id_ms BIGINT, id_seq BIGINT, payload STRING"
DELIVERY = "stream STRING, group_name STRING, consumer STRING, id_ms BIGINT, id_seq BIGINT"
ACK = "stream STRING, group_name STRING, id_ms BIGINT, id_seq BIGINT"
SEEN, SEEN_META = "item STRING", "key_name STRING, expires_at TIMESTAMP"
CACHE = "key STRING, value STRING, stored_at TIMESTAMP, ttl_s INT"
REQUEST = "request_id BIGINT, url STRING, ts TIMESTAMP"
SOURCE = "id STRING, name STRING, url STRING, category STRING, is_active BOOLEAN, created_at TIMESTAMP"
ARTICLE_ROW = "id STRING, url STRING, title STRING, content STRING, source_id STRING, published_at TIMESTAMP, analysis_status STRING, created_at TIMESTAMP"
EMBEDDING = "id STRING, article_id STRING, embedding ARRAY<FLOAT>, model_name STRING, embedding_type STRING, created_at TIMESTAMP"
SYS_STATS = (
    "cpu STRUCT<logical_cores: INT, physical_cores: INT, percent: DOUBLE, individual_cpu_stats: ARRAY<STRUCT<times: MAP<STRING, DOUBLE>, percent: DOUBLE>>>, "
    "memory STRUCT<ram: MAP<STRING, DOUBLE>, swap: MAP<STRING, DOUBLE>>, network MAP<STRING, BIGINT>"
)
