"""Training-data operators: extraction, quality, language, toxicity, PII, tokenizing, deduplication.

Nothing outside this package imports it. Functions that run on executors are shipped by value, so
executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
