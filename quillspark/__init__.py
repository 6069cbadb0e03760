"""quillspark: Spark-native sentence-corpus preparation and classifier evaluation.

Column builders live in ``functions``; DataFrame -> DataFrame operators in
``operators``; readers, writers and fixture views in ``sources``; composed
jobs and the query registry in ``plans``; incremental (file-stream) runners in
``streaming``.
"""

__version__ = "0.1.0"
