"""Part of the tidewatch signal analytics engine."""
