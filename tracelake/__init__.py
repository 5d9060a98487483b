"""tracelake: forensic and incident-response analytics as Spark DataFrame transforms."""
