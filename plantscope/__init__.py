"""plantscope: find which measured variables drive a target, on Spark.

Every public function takes and returns Spark DataFrames (or small fitted
summaries whose size depends on the number of columns, never on the rows).
"""
