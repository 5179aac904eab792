"""Public-works analytics and risk scoring as PySpark DataFrame operators."""
