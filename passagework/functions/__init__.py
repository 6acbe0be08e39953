"""Part of passagework."""
