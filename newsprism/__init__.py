"""newsprism: labelled-article analytics and linear text classification on Spark.

Every step is a DataFrame / SQL / Spark ML job; only bounded results
(vocabularies, coefficients, metric rows) ever reach the driver.
"""

from newsprism.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
