"""Stored tables as DDL; timestamps are UTC."""

from __future__ import annotations

ARTICLE = "id string, title string, url string, source_id int, source_name string, source_tier int, published_at timestamp, retrieved_at timestamp, content string, content_hash string, language string"
CLASSIFICATION = "article_id string, category string, subcategory string, entities array<string>, is_relevant boolean, importance_score int, relevance_score int, confidence double, competitor_match string"
EVENT = "id string, canonical_title string, event_date timestamp, category string, subcategory string, canonical_url string, canonical_source_name string, canonical_source_tier int, summary string, importance_score int, verification_status string, verification_source string"
TABLES = {
    "articles": ARTICLE,
    "article_classifications": CLASSIFICATION,
    "events": EVENT,
    "event_articles": "event_id string, article_id string",
    "sent_news": "event_id string, canonical_url string, canonical_title string, sent_at timestamp, recipient string, run_id string",
    "workflow_runs": "run_id string, started_at timestamp, completed_at timestamp, status string, events_sent int, counters map<string,bigint>, error string",
}
