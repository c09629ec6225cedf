"""siterank: choosing planetary landing sites with Spark DataFrames.

Subpackages

* ``sources``    table views, file readers, sinks and artefact stores
* ``functions``  column functions: scaling, transforms, scores, geometry
* ``operators``  DataFrame-to-DataFrame operators (joins, windows, fits)
* ``plans``      whole queries built from the operators
* ``streaming``  the same plans over request streams
"""
