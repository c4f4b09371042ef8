"""Log analytics and fault diagnosis as Spark jobs.

Sub-packages:

* ``sources``   table schemas, readers and writers
* ``functions`` column expressions (no joins, no shuffles)
* ``operators`` DataFrame to DataFrame building blocks
* ``learning``  folds, weights, over-sampling, two-stage training, scores
* ``plans``     the three end-to-end stages and the registered queries
"""
