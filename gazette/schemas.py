"""Schemas of the tables, as DDL: they can be read without a session."""

SOURCES = "id int, source_type string, name string, email_address string, website string, signup_url string, ward_number string, phone string, newsletter_archive_url string"
NEWSLETTERS = "id string, created_at timestamp, email_uid string, received_date timestamp, subject string, from_email string, to_email string, raw_html string, plain_text string, summary string, topics array<string>, source_id int, relevance_score int"
EMAIL_MAPPINGS = "id int, email_pattern string, source_id int, notes string, created_at timestamp"
PROFILES = "id string, email string, created_at timestamp, updated_at timestamp, notification_preferences string"
REPORTS = "id string, topic string, week_id string, report_summary string, newsletter_ids array<string>, key_developments array<struct<description:string,newsletter_ids:array<string>,wards:array<string>>>, created_at timestamp"
RULES = "id string, user_id string, name string, is_active boolean, created_at timestamp, updated_at timestamp, topics array<string>, search_term string, min_relevance_score int, source_ids array<int>, ward_numbers array<string>, delivery_frequency string"
QUEUE = "id string, user_id string, newsletter_id string, report_id string, rule_id string, status string, digest_batch_id string, notification_type string, created_at timestamp, sent_at timestamp, error_message string"
HISTORY = "id string, user_id string, newsletter_ids array<string>, rule_ids array<string>, digest_batch_id string, delivery_type string, sent_at timestamp, success boolean, error_message string, resend_email_id string"
PRICING = "version string, updated string, models array<struct<provider:string,model:string,input_cost_per_1m:double,output_cost_per_1m:double,context_window:int,encoding:string,notes:string>>"
PREFERENCES = "enabled boolean, delivery_frequency string"
MAIL = "uid string, from_ string, subject string, date timestamp, html string, text string, `to` array<string>, seen boolean"
