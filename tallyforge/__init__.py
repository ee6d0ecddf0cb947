"""tallyforge: ledger analytics as Spark DataFrame jobs.

Source transactions from many accounts live in ONE table keyed by ``account``; rules, transfer
mappings, category trees and configuration are small DataFrames.  Every operator is a function
``DataFrame -> DataFrame`` that Catalyst plans; nothing is collected to the driver except bounded
configuration.
"""

__version__ = "0.1.0"

# Version tag mixed into refresh fingerprints: bump when an operator's output changes.
LOGIC_VERSION = "tallyforge-1"
