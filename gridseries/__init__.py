"""Monthly gridded time series and model ensembles on Spark DataFrames.

``functions`` holds column expressions, ``operators`` DataFrame-to-DataFrame
transforms, ``sources`` readers and writers, ``streaming`` micro-batch jobs and
``plans`` the composed queries that ``__spark_entry__.py`` registers.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
