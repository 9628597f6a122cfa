"""Set-oriented operators over many sites."""
