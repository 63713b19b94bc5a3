"""fundlens: analytics over public funding registers, expressed as Spark DataFrame plans.

Layout
------
sources/    raw delimited export ingest, the driver-table view, JSON document reader
functions/  pure Column -> Column expressions (locale parsing, blanks, tokens, formats)
operators/  marts, trends, duration, keywords, statistics, forecast, quality, snapshot diff
plans/      the refresh job, publishing, and the named query registry
streaming/  drop-folder trigger that runs the refresh job per arriving snapshot
"""

from fundlens.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
