"""reviewlens: review-summarisation analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by product (``asin``) or by
cluster label, so all products are processed in one Spark job.  Sub-packages:

* ``sources``   – table loaders, the shared ``reviews`` view, file formats (S1-S14)
* ``functions`` – Column-level scalar functions (F1-F22) and repeatable randomness
* ``operators`` – grouped / joined / windowed operators (votes, text, vectors,
                  clustering, diagnostics, training sets, ROUGE, search)
* ``plans``     – end-to-end plans (summarise all products) and the query catalog
"""

from reviewlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
