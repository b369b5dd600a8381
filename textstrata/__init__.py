"""textstrata: Spark-native operators for labelling large tables of short texts.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``)
that takes column names as arguments.  Sub-packages:

* ``functions``  column expressions (hashing, text rules, array maths, the pick fold)
* ``operators``  table operators (cleaning, labels, ordered carry-forward, statistics,
  sampling and splitting, encoding, training, label picking)
* ``sources``    readers and writers (delimited text, split sets, weights, model bundles)
* ``plans``      end-to-end jobs composed from the operators, and the bindings of
  the operators to the test tables
* ``streaming``  the file-stream prediction job
"""

__version__ = "0.1.0"
