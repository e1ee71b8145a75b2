"""The canonical views over the driver's tables in DuckDB's SQL, as `sources.library.DriverLibrary` has them."""

from __future__ import annotations

import re

VIEWS = {
    "reading_time": """SELECT event_id AS id, user_id AS book_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS date,
        CAST(floor(value) AS BIGINT) AS reading_time, CAST(ts AS DATE) AS day FROM events""",
    "books": """SELECT p_partkey AS id, p_name AS title, '' AS cover_path, 'file/' || p_partkey || '.' || list_extract(['epub', 'mobi', 'azw3', 'fb2', 'txt', 'pdf'], CAST(p_partkey % 6 AS INT) + 1) AS file_path,
        'epubcfi(/6/' || (2 * (p_partkey % 30) + 2) || '!/4/' || (2 * (p_partkey % 9) + 2) || ')' AS last_read_position, p_size / 50.0::DOUBLE AS reading_percentage, p_brand AS author, p_partkey % 10 = 0 AS is_deleted,
        CASE WHEN p_partkey % 2 = 0 THEN p_type END AS description, CAST(p_partkey % 6 AS DOUBLE) AS rating, p_partkey % 7 AS group_id,
        CASE p_partkey % 3 WHEN 1 THEN md5(p_name) WHEN 2 THEN '' END AS file_md5, TIMESTAMP '2023-06-01 00:00:00' + to_hours(CAST(p_partkey AS INT)) AS create_time,
        TIMESTAMP '2023-12-01 00:00:00' + to_minutes(CAST((p_partkey * 37) % 50000 AS INT)) AS update_time FROM part""",
    "notes": """SELECT doc_id + 1 AS id, doc_id % 150 AS book_id, text AS content,
        'epubcfi(/6/' || (2 * (doc_id % 40) + 2) || '!/4/' || (2 * (doc_id % 25) + 2) || '/1:' || (doc_id % 97) || ')' AS cfi, source AS chapter,
        list_extract(['highlight', 'underline', 'bookmark', 'draft'], CAST(doc_id % 4 AS INT) + 1) AS type,
        CASE WHEN doc_id % 4 = 2 THEN printf('%.2f', (doc_id % 100) / 100.0::DOUBLE) ELSE list_extract(['66ccff', 'FF0000', '00FF00', 'EB3BFF', 'FFD700', '123456'], CAST(doc_id % 6 AS INT) + 1) END AS color,
        CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE 'note ' || doc_id || ' ' || lang END AS reader_note,
        CASE WHEN doc_id % 11 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 7 AS INT)) END AS create_time,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((doc_id * 7919) % 40000 AS INT)) AS update_time FROM documents""",
    "lib_groups": """SELECT 0::BIGINT AS id, 'Root' AS name, NULL::BIGINT AS parent_id, false AS is_deleted
        UNION ALL SELECT CAST(r_regionkey + 1 AS BIGINT), r_name, 0::BIGINT, false FROM region
        UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), n_name, CAST(n_regionkey + 1 AS BIGINT), n_nationkey % 9 = 8 FROM nation""",
    "tags": "SELECT * FROM (VALUES (1::BIGINT, 'quality', 6737151::BIGINT), (2, 'Toxic', 16711680), (3, 'unused', NULL)) AS t(id, name, rgb)",
    "book_tags": """SELECT CAST(doc_id * 2 + 1 AS BIGINT) AS id, doc_id AS book_id, 1::BIGINT AS tag_id FROM labels WHERE quality = 1
        UNION ALL SELECT CAST(doc_id * 2 + 2 AS BIGINT), doc_id, 2::BIGINT FROM labels WHERE toxic = 1""",
    "sections": "SELECT doc_id % 150 AS book_id, CAST(doc_id // 150 AS INT) AS section_idx, source || ' ' || lang AS title, 's' || (doc_id // 150) || '.xhtml' AS href, text AS content FROM documents",
    "history": "SELECT conv_id AS id, count(*) AS n_messages, (conv_id * 7919) % 100003 AS updated_at FROM conversations GROUP BY conv_id",
    "files": """SELECT split_part(file_path, '/', 2) AS name, 'local' AS side FROM books WHERE rating <> 3
        UNION ALL SELECT split_part(file_path, '/', 2), 'remote' FROM books WHERE group_id <> 2 UNION ALL SELECT * FROM (VALUES ('stray-a.epub', 'local'), ('stray-b.epub', 'remote')) AS t(name, side)""",
}
_NEEDS = {"files": ["books"]}


def with_views(sql: str) -> str:
    """The statement with the views that it names before it."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    wanted = [v for v in VIEWS if v in named or any(v in _NEEDS.get(n, ()) for n in named)]
    if not wanted:
        return sql
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    return f"WITH {heads}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {heads} {sql}"
