"""watchfloor: detection matching and coverage analytics as PySpark DataFrame operators.

Telemetry, rules and vulnerability intelligence are tables; every operator takes DataFrames and returns one,
so a whole report is a single lazy plan for Catalyst and AQE to optimise.
"""

__version__ = "0.1.0"
