"""Schemas of the application's tables, as DDL."""

from __future__ import annotations

SECTION = "STRUCT<heading STRING, text STRING, anchor STRING>"
PAGES = "series STRING, edition STRING, year INT, url STRING, html STRING"
CALLS = "series STRING, edition STRING, year INT, url STRING, call_url STRING, snapshot_url STRING, title STRING, heading STRING, text STRING, important_dates ARRAY<STRING>"
EDITIONS = "series STRING, edition STRING, year INT, url STRING, status STRING, crawl_url STRING, pages BIGINT, calls BIGINT"
ERRORS = "url STRING, error STRING"
ATTEMPTS = "url STRING, attempted_at STRING, status STRING, snapshot_url STRING, detail STRING"
RUN = "STRUCT<text STRING, start INT, font STRING, size DOUBLE>"
ITEMS = "doc_id STRING, page INT, item_no INT, text STRING, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, scale_x DOUBLE, scale_y DOUBLE, font STRING, eol BOOLEAN"
LINE = f"STRUCT<line_no INT, text STRING, page INT, boxes ARRAY<ARRAY<DOUBLE>>, runs ARRAY<{RUN}>>"
LINES = f"doc_id STRING, line_no INT, text STRING, page INT, boxes ARRAY<ARRAY<DOUBLE>>, runs ARRAY<{RUN}>"
LINK = "STRUCT<url STRING, page INT, rect ARRAY<DOUBLE>>"
LINKS = "doc_id STRING, url STRING, page INT, rect ARRAY<DOUBLE>"
EXTRACTED = f"doc_id STRING, pages INT, lines ARRAY<{LINE}>, annotations ARRAY<{LINK}>"
STATEMENT = "STRUCT<section_id STRING, section_label STRING, heading STRING, start INT, end INT, page INT, text STRING, body STRING>"
DOI = "STRUCT<id STRING, sources ARRAY<STRING>>"
ARTIFACT = "STRUCT<url STRING, sources ARRAY<STRING>>"
ANALYSIS = f"doc_id STRING, pages INT, has_text BOOLEAN, statements ARRAY<{STATEMENT}>, dois ARRAY<{DOI}>, repository_links ARRAY<{ARTIFACT}>, error STRING"
ANNOTATION = "STRUCT<type STRING, count_as_artifact BOOLEAN, artifact_type STRING, location STRUCT<section STRING, page INT>, urls ARRAY<STRING>, note STRING, excerpt STRING>"
AUTHORS = "year INT, id STRING, authors ARRAY<STRING>"
DOI_CHECK = "url STRING, status INT, ok BOOLEAN, final_url STRING, redirected BOOLEAN, error STRING"
REGISTRY = "STRUCT<titles ARRAY<STRUCT<title STRING>>, creators ARRAY<STRUCT<name STRING>>, publisher STRING, publicationYear INT, version STRING, types MAP<STRING, STRING>, url STRING, rightsList ARRAY<STRUCT<rights STRING>>, descriptions ARRAY<STRUCT<description STRING>>>"

_SECTION_ROW = "STRUCT<id STRING, label STRING, heading STRING, page INT, body STRING>"
PAPER = f"STRUCT<sort_key STRING, id STRING, file STRING, url STRING, sections ARRAY<{_SECTION_ROW}>, dois ARRAY<STRING>, repository_links ARRAY<{ARTIFACT}>, annotation {ANNOTATION}>"
YEAR = f"STRUCT<total BIGINT, checked BIGINT, with_statement BIGINT, with_statement_and_doi BIGINT, with_replication_package BIGINT, without_statement BIGINT, no_text BIGINT, errors BIGINT, papers ARRAY<{PAPER}>, false_positives ARRAY<{PAPER}>, annotations ARRAY<{PAPER}>>"
RESPONSES = "snapshot_url STRING, status INT, body STRING"
ROBOTS = "host STRING, status INT, body STRING"
