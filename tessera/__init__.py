"""tessera: sensitive-data discovery and classification on Spark.

Operators are plain functions ``DataFrame -> DataFrame`` or
``Column -> Column``; nothing inside them collects data to the driver.
"""

__version__ = "0.1.0"
