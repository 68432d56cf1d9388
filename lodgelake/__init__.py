"""lodgelake: lodging-booking analytics as Spark DataFrame operators.

Every public operator takes DataFrames (and plain parameters such as an
explicit ``as_of`` timestamp) and returns a DataFrame.  Nothing runs until
the caller triggers an action, so Catalyst sees and optimises the whole plan.
"""

AS_OF_DEFAULT = "1998-06-15 10:30:00"
