"""causeway: Spark-native operators for estimating treatment effects from text and tables.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregates, windows and MLlib fits.  Sub-packages:

* ``functions``  column expressions (text predicates, codes, arrays, draws)
* ``operators``  table operators (cleaning, threads, discretisation, grids,
                 sampling, estimators, evaluation, dialog, baselines)
* ``sources``    scans and sinks (archives, array text, resume, batch scorer)
* ``plans``      bindings of the operators to the driver tables (queries)
* ``streaming``  the stateless curation rules on a streaming source
"""

from causeway.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
