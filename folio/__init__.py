"""folio: a Spark-native document question engine.

Documents are split into pages, embedded and kept in a partitioned chunk table; batches
or streams of questions are answered by an exact (or approximate) top-k similarity join;
topics and multiple-choice questions are derived per document; question/answer data is
shaped into instruction sets. Everything is DataFrame / SQL / Structured Streaming code.
"""

from folio.session import get_session, checkpoint_dir  # noqa: F401
