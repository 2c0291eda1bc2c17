"""Part of forkline."""
