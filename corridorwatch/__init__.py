"""Road-risk analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame``; nothing here runs an
action, except the sinks, the streaming starters and the model fits.
"""
