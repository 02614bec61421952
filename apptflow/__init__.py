"""apptflow: missed-appointment analytics as Spark DataFrame transformations.

Every public operator takes DataFrames (plus column names and parameters) and
returns a DataFrame; nothing is collected to the driver except by the model
code, which grows trees over packed blocks of rows.
"""

__version__ = "0.1.0"
