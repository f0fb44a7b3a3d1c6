"""textwarden: text-compliance checks, evidence and posture roll-ups as Spark plans."""
