"""Queries of the incremental selection and their SQL."""

from __future__ import annotations

from fernweh.operators import incremental
from fernweh.runtime import read, shared_path


def p3_found(spark, d):
    """Files that the next run has to read, per stage: what the logs say is done becomes a version of the state, and the current rows are compared with that."""
    files, content_map, vec_files, index_runs, ocr_cache = [read(spark, d, t) for t in ("files", "content_map", "vec_files", "index_runs", "ocr_cache")]
    state = incremental.RunState(spark, shared_path(spark, "run-state"))
    state.commit(incremental.done(vec_files, index_runs, ocr_cache))
    return incremental.due(files, content_map, state.load(incremental.STATE))


QUERIES = {"p3_found": p3_found}

SQL = {
    "p3_found": r"""
        WITH now AS (
          SELECT f.id AS file, concat_ws(':', f.size, f.mtime, f.content_len, regexp_replace(f.name, '^(.+)\.[^.]*$', '\1', 's'), 'text', coalesce(m.hash, '#' || m.text)) AS sig
          FROM files f JOIN content_map m ON m.id = f.id
          WHERE NOT f.is_dir AND f.content_state = 1 AND f.content_len > 0
        ), last AS (
          SELECT v.*, row_number() OVER (PARTITION BY v.file ORDER BY v.run_id DESC, v.committed_at DESC, v.upto DESC, v.total DESC, v.sig DESC) AS r
          FROM vec_files v JOIN index_runs USING (run_id) WHERE status = 'ok'
        )
        SELECT 'passages' AS stage, now.file FROM now LEFT JOIN last ON last.file = now.file AND r = 1
        WHERE last.file IS NULL OR last.sig IS DISTINCT FROM now.sig OR NOT coalesce(last.upto >= last.total, false)
        UNION
        SELECT 'ocr', f.id FROM files f
        WHERE f.kind IN ('image', 'pdf') AND f.content_state IN (1, 4) AND NOT EXISTS (
          SELECT 1 FROM ocr_cache o WHERE o.version = 1 AND o.dev = f.dev AND o.ino = f.ino AND o.size = f.size AND o.mtime = f.mtime AND o.ctime_ms = f.ctime_ms)
    """,
}
