"""riskweave: customer risk analytics expressed as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` that stays lazy.
Fitted steps return a small parameters DataFrame that the matching ``apply_*``
function joins back; nothing data-sized is collected on the driver.
"""

__version__ = "0.1.0"
