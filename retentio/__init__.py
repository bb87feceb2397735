"""retentio: customer-retention analytics as Spark DataFrame jobs.

Entry points: ``retentio.plans.lifecycle`` (end-to-end flows),
``retentio.plans.batch`` (the scoring chain), ``retentio.operators.*`` (the
inventory operators), ``python -m retentio`` (command line).
"""

__version__ = "0.1.0"
