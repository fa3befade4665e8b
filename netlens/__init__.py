"""netlens: Spark-native analytics for Zeek network logs.

Layers:
  sources/    read rotated Zeek TSV logs, the driver-table log views, ingest + sinks
  functions/  Column builders (hour bucket, predicates with their null rules)
  operators/  generic DataFrame -> DataFrame operators (frequency, hourly, summary, dense)
  plans/      the named analytics per log type and the query catalogue
  streaming/  the hourly features over a stream of landed or rotated logs
"""

__version__ = "0.1.0"
