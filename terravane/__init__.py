"""terravane: terrain-hazard analytics as Spark DataFrame operators.

The row of every table is one grid cell ``(site, r, c)``; all sites run in one
job.  ``functions`` holds Column expressions, ``operators`` DataFrame
transformations, ``sources`` readers and writers, ``streaming`` the Structured
Streaming jobs and ``plans`` the end-to-end compositions.
"""
