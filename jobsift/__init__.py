"""jobsift: vacancy recommendation analytics as Spark DataFrame jobs.

Every public operator is a function from DataFrames (plus parameters) to a
DataFrame.  Nothing here creates a session, collects fact data to the driver
or loops over rows in Python; the work is declared with the DataFrame API and
left to Catalyst / AQE to plan.
"""

__version__ = "0.1.0"
