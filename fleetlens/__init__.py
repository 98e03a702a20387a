"""Fleet telemetry and audit for database operators, as Spark jobs.

Every public operator takes DataFrames and returns a DataFrame; nothing here
runs an action unless its docstring says so.
"""
